import base64
import hashlib
import json
import re

import pytest

from lectern.llm import secrets


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


b64 = lambda b: base64.b64encode(b).decode()
url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
RSA = der(0x30, der(2, b"\x00"), *[der(2, bytes([i + 1]) * 64) for i in range(8)])
PKCS8 = der(0x30, der(2, b"\x00"), der(0x30, der(6, b"\x2a\x86\x48")), der(4, RSA))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(3, b"\x00" * 60))
EC = der(0x30, der(2, b"\x01"), der(4, b"\x07" * 32))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"\x05" * 32))
JWT = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': 1})}.c2lnbmF0dXJl"


def plain_base(text):
    found = []
    for m in secrets.ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            found.append((m.start(), m.end(), "assign"))
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


TEXTS = [
    None, "", "no secrets", "Token = 'abcdef' PASSWORD:x ſecret=abcdefgh api_key=\"Ab+/9._-=\"", "token:token:abcdefgh", "token=secret=abcdef", "AKIA" + "Q" * 16 + " AKIA123 AKIAAKIA" + "1" * 12,
    "é" * 9 + "0" * 24 + "g" + "a" * 23 + " f" * 30, "token=" + "0a" * 30, "a" * 200_000, "x=" * 1000,
]


def test_base_spans_match_plain_patterns(spark):
    df = spark.createDataFrame([(i % 9, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    got = sorted(map(tuple, secrets.digest(secrets.find_secrets(df)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()))
    want = []
    for i, t in enumerate(TEXTS):
        base = plain_base(t or "")
        n = lambda k, base=base: sum(s[2] == k for s in base)
        want.append((i % 9, n("assign"), n("access"), n("hex"), hashlib.sha256(secrets.listed(base).encode()).hexdigest()))
    assert got == sorted(want)
    assert secrets.digest(secrets.find_secrets(df.limit(0))).collect() == []


@pytest.mark.parametrize("key", [RSA, PKCS8, PUBLIC, EC])
def test_keys_in_base64_and_hex(key):
    for text in (b64(key), key.hex(), key.hex().upper()):
        found = secrets.scan(f"x {text} y")
        assert (2, 2 + len(text), "der") in found
    broken = bytearray(key)
    broken[3] ^= 1
    inner = b64(key).find(b64(RSA)[:40]) if key is PKCS8 else -1  # the whole key within the broken one is still one
    assert [s[0] for s in secrets.scan(b64(bytes(broken))) if s[2] not in secrets.BASE_KINDS] == [inner] * (inner >= 0)


def test_tokens_armour_and_ssh():
    assert secrets.scan(f"see {JWT}.") == [(4, 4 + len(JWT), "jwt")]
    assert secrets.scan(f"{url({'typ': 'x'})}.{url({'sub': 1})}.abc") == []
    assert [s[2] for s in secrets.scan("ssh-ed25519 " + b64(SSH))] == ["ssh"]
    body = "\n".join(b64(PKCS8)[i : i + 64] for i in range(0, len(b64(PKCS8)), 64))
    armour = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    assert secrets.scan(f"a\n{armour}") == [(2, 2 + len(armour), "pem")]
    assert not any(s[2] == "pem" for s in secrets.scan(armour.replace(body, "bm90IGEga2V5")))


def test_finds_planted_tokens_in_stored_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.spans for r in secrets.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: secrets.listed(plain_base(r.text)) for r in docs.collect()}


def test_url_safe_prefixed_and_wrapped_secrets():
    body = bytes(range(256)) + b"\xff\xfe" * 20
    key = der(0x30, der(2, b"\x01" + body), der(2, b"\x01\x00\x01"))
    safe = base64.urlsafe_b64encode(key).decode().rstrip("=")
    assert "-" in safe[38:] and (2, 2 + len(safe), "der") in secrets.scan(f"x {safe} y")
    assert (14, 14 + len(JWT), "jwt") in secrets.scan(f"session_token.{JWT}")
    for blob, kind in ((RSA, "der"), (key, "der"), (SSH, "ssh")):
        text = "\n".join(b64(blob)[i : i + 40] for i in range(0, len(b64(blob)), 40))
        assert (4, 4 + len(text), kind) in secrets.scan(f"see {text}\nand so on")
        assert (22, 22 + len(text), kind) in secrets.scan(f"MyLongIdentifier12345\n{text}\nand so on")


def brute_keys(text):
    """Every span of base64, with line ends between its pieces, that decodes to a key: all starts and ends are tried."""
    found, i = [], 0
    while i < len(text):
        hit = None
        if text[i] in "MAb":
            for j in range(i + 16, len(text) + 1):
                if re.fullmatch(r"[A-Za-z0-9+/_-]+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*", text[i:j]):
                    data = secrets.decode_base64(re.sub(r"\s", "", text[i:j]))
                    if kind := "der" if secrets.is_der_key(data) else "ssh" if secrets.is_ssh_key(data) else None:
                        hit = (i, j, kind)  # one more character may decode to the same bytes
                        break
        if hit:
            found.append(hit)
        i = hit[1] if hit else i + 1
    return found


OPENSSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (SSH, b"\x09" * 70))
JWE = ".".join([url({"alg": "dir", "enc": "A128GCM"}), "", "AAECAwQFBgcICQoL", "c2VjcmV0", "AAECAwQFBgcICQoLDA0ODw"])


@pytest.mark.parametrize("key", [EC, PUBLIC, SSH, OPENSSH])
@pytest.mark.parametrize("lead", ["", "path/to/", "Mix3dPrefix", "AAAAMII"])
def test_keys_match_every_start_and_end_tried(key, lead):
    text = b64(key).rstrip("=")
    for body in (text, "\n".join(text[i : i + 20] for i in range(0, len(text), 20)), text + "tail", text[:-3]):
        got = [s for s in secrets.scan(f"see {lead}{body}\n\nend") if s[2] in ("der", "ssh")]
        want = brute_keys(f"see {lead}{body}\n\nend")
        assert [(a, k) for a, _, k in got] == [(a, k) for a, _, k in want] and all(0 <= x[1] - y[1] <= 1 for x, y in zip(got, want, strict=True))
        assert bool(want) == (body != text[:-3]) or lead == "AAAAMII"


def test_encrypted_keys_and_tokens_are_parsed():
    block = lambda label, body, head="": f"-----BEGIN {label}-----\n{head}{body}\n-----END {label}-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,000102030405060708090A0B0C0D0E0F\n\n"
    kinds = lambda t: [s for s in secrets.scan(t) if s[2] not in secrets.BASE_KINDS]
    good = block("RSA PRIVATE KEY", b64(b"\x01" * 64), head)
    assert kinds(f"x {good}") == [(2, 2 + len(good), "pem")]
    assert kinds(block("RSA PRIVATE KEY", b64(b"\x01" * 63), head)) == []  # not whole blocks
    assert kinds(block("RSA PRIVATE KEY", b64(b"\x01" * 64), head.replace("0F\n", "\n"))) == []  # a short vector
    assert kinds(block("ENCRYPTED PRIVATE KEY", b64(b"\x01" * 64))) == []  # a label alone confirms nothing
    protected = der(0x30, der(0x30, der(6, b"\x2a\x86"), der(5)), der(4, b"\x02" * 48))
    assert [s[2] for s in kinds(block("ENCRYPTED PRIVATE KEY", b64(protected)))] == ["pem"]
    assert kinds(f"a.b.{JWE} x") == [(4, 4 + len(JWE), "jwe")]
    assert kinds(f"{JWT.split('.')[0]}." + JWE.split(".", 1)[1]) == []
    assert kinds(block("OPENSSH PRIVATE KEY", b64(OPENSSH[:-1]))) == []
    assert kinds("-----BEGIN A KEY-----" * 3000 + "MA" * 5000 + "A" * 300_000 + "AAAAB3NzaC1" * 2000) == []
