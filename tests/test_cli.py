import json
import zlib

from lectern.__main__ import main
from lectern.plans import samples

DATA = "/root/testdata/sf0.001"


def test_stages_from_texts_to_tables(spark, tmp_path):
    from lectern.sources import sinks

    texts = samples.testimonies(spark, DATA).limit(12)
    sinks.write_texts(texts, f"file://{tmp_path}/txt", text_col="text")
    assert main(["metadata", f"{tmp_path}/txt", f"{tmp_path}/m"], spark) == 0
    table = f"{tmp_path}/m/metadata.parquet"
    assert spark.read.parquet(table).where("name LIKE 'Ewa N%'").count() == 12
    assert main(["verbs", table, f"{tmp_path}/v", "--max-docs", "5"], spark) == 0
    verbs = f"{tmp_path}/v/verbs.parquet"
    assert {r.doc_id for r in spark.read.parquet(verbs).select("doc_id").collect()} <= {str(r.testimony_number) for r in spark.read.parquet(table).collect()}
    report = json.loads(spark.read.text(f"{tmp_path}/v/verb_report.json").first().value)
    assert report["active_affirmative_count"] > 0 and "walk" in report["top_active_affirmative_verbs"] and report["top_passive_negated_verbs"] == {}
    assert main(["verb-filter", verbs, f"{tmp_path}/f", "--lemma", "walk"], spark) == 0
    assert main(["verb-filter", verbs, f"{tmp_path}/f", "--lemma", "wall"], spark) == 1
    assert spark.read.csv(f"{tmp_path}/f/walk.csv", header=True).count() == 5
    assert main(["search", table, f"{tmp_path}/s", "--phrase", "the  winter?", "--gender", "FEMALE"], spark) == 0
    assert not (tmp_path / "s").exists()
    assert main(["search", table, f"{tmp_path}/s", "--phrase", "The winter", "--gender", "FEMALE"], spark) == 0
    found = spark.read.csv(f"{tmp_path}/s/the_winter_FEMALE.csv", header=True)
    assert found.columns == ["doc_id", "sentence_idx", "sentence", "gender"] and found.count() == 12
    assert main(["entities", table, f"{tmp_path}/e", "--checkpoint", f"{tmp_path}/ck"], spark) == 0 and not (tmp_path / "ck").exists()
    assert main(["clouds", f"{tmp_path}/e", f"{tmp_path}/e", "--exclude", "X, Y", "--no-default-exclude"], spark) == 0
    report = json.loads(spark.read.text(f"{tmp_path}/e/ner_report.json").first().value)
    assert report["total_documents"] == 12 and report["total_entities"] == sum(report.get("entities_by_type", {}).values())
    assert main(["pacing", f"{tmp_path}/e", f"{tmp_path}/p"], spark) == 0
    report = json.loads(spark.read.text(f"{tmp_path}/p/pacing_report.json").first().value)
    assert report["n_sections"] == 3 and report["noise_filtered"] == report["category_counts"]["noise"]
    assert main(["bow", table, f"{tmp_path}/b"], spark) == 0
    assert main(["bow", table, f"{tmp_path}/b", "--text-column", "none"], spark) == 1
    assert main(["search", f"{tmp_path}/none", f"{tmp_path}/s", "--phrase", "x"], spark) == 1
    spark.read.parquet(table).drop("gender").write.parquet(f"{tmp_path}/plain")
    assert main(["search", f"{tmp_path}/plain", f"{tmp_path}/s", "--phrase", "winter", "--gender", "female"], spark) == 1
    (tmp_path / "sheet.csv").write_text("A\nwinter\n")
    assert main(["categories", table, f"{tmp_path}/c", "--sheet", f"{tmp_path}/sheet.csv", "--category", "A"], spark) == 0
    assert main(["categories", table, f"{tmp_path}/c", "--sheet", f"{tmp_path}/sheet.csv", "--category", "B"], spark) == 1
    assert main(["categories", table, f"{tmp_path}/c2", "--from-sheet", f"{__name__}:sheet_rows", "--to-sheet", f"{__name__}:TAB.extend", "--category", "A"], spark) == 1
    assert main(["categories", table, f"{tmp_path}/c2", "--from-sheet", f"{__name__}:sheet_rows", "--to-sheet", f"{__name__}:replace_tab", "--category", "A"], spark) == 0
    assert TAB[0] == ["doc_id", "sentence_idx", "matched_word", "sentence"] and {r[2] for r in TAB[1:]} == {"winter", "snow"} and len(TAB) == 25
    assert main(["categories", table, f"{tmp_path}/c", "--from-sheet", "nothing:none", "--category", "A"], spark) == 1


TAB: list = []


def sheet_rows():
    return [["A", "B"], ["winter", "x"], ["snow"]]


def replace_tab(rows):
    TAB[:] = rows


def pdf(*pages):
    """A PDF of one deflated stream a page."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))))]
    for i, content in enumerate(pages):
        data = zlib.compress(content)
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdfs_to_a_corpus(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(pdf(rb"BT /F1 12 Tf (One \(1\)) Tj 0 -14 Td [(t) 20 (wo) -400 (words)] TJ ET", rb"BT (caf\351) Tj T* <6869> Tj ET"))
    (tmp_path / "in/b.pdf").write_bytes(b"not one")
    (tmp_path / "in/c.txt").write_text("other")
    assert main(["pdf", f"{tmp_path}/in", f"{tmp_path}/out"], spark) == 0
    rows = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out/corpus.parquet").collect()}
    assert set(rows) == {"a", "b"} and rows["b"].error == "not a PDF" and (rows["b"].n_pages, rows["b"].full_text) == (0, "")
    assert (rows["a"].n_pages, rows["a"].full_text, rows["a"].n_words) == (2, "One (1)\ntwo words\n\ncafé\nhi", 6)
    assert [p.name for p in (tmp_path / "out/txt").iterdir() if p.suffix == ".txt"] == ["a.txt"]
