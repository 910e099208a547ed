"""Added secret kinds: planted keys in many encodings, look-alikes, and time on hostile texts."""

import base64
import random
import time

import pytest

from quantloom.llm import secretscan


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


rng = random.Random(11)
number = lambda n: der(2, bytes([rng.randint(1, 127)]) + rng.randbytes(n - 1))
oid = lambda x: der(6, bytes.fromhex(x))
null = der(5, b"")
RSA_OID, EC_OID, DSA_OID, ED_OID = "2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2b6570"
pkcs1 = lambda: der(0x30, der(2, b"\0") + number(128) + number(3) + number(128) + b"".join(number(64) for _ in range(5)))
sec1 = lambda: der(0x30, der(2, b"\1") + der(4, rng.randbytes(32)) + der(0xA0, oid("2a8648ce3d030107")))
pkcs8 = lambda algorithm, inner, more=null: der(0x30, der(2, b"\0") + der(0x30, oid(algorithm) + more) + der(4, inner))
dsa = lambda: der(0x30, der(2, b"\0") + number(128) + number(20) + number(128) + number(128) + number(20))
sealed = lambda scheme: der(0x30, der(0x30, oid(scheme) + der(0x30, b"")) + der(4, rng.randbytes(160)))
text_of = lambda x: len(x).to_bytes(4, "big") + x
ssh = lambda: b"openssh-key-v1\0" + text_of(b"none") + text_of(b"none") + text_of(b"") + (1).to_bytes(4, "big") + text_of(rng.randbytes(51)) + text_of(rng.randbytes(136))
KEYS = {
    "PKCS#1": pkcs1, "SEC1": sec1, "DSA": dsa, "OpenSSH": ssh, "PKCS#8 RSA": lambda: pkcs8(RSA_OID, pkcs1()), "PKCS#8 EC": lambda: pkcs8(EC_OID, sec1(), oid("2a8648ce3d030107")),
    "PKCS#8 DSA": lambda: pkcs8(DSA_OID, number(20), der(0x30, number(128))), "PKCS#8 Ed25519": lambda: pkcs8(ED_OID, der(4, rng.randbytes(32)), b""),
    "PBES2": lambda: sealed("2a864886f70d01050d"), "PKCS#12 PBE": lambda: sealed("2a864886f70d010c0103"),
}
OTHERS = {
    "DigestInfo": lambda: der(0x30, der(0x30, oid("608648016503040201") + null) + der(4, rng.randbytes(32))),
    "public key": lambda: der(0x30, der(0x30, oid(RSA_OID) + null) + der(3, b"\0" + rng.randbytes(140))),
    "PKCS#8 with no key inside": lambda: pkcs8(RSA_OID, rng.randbytes(100)),
    "PKCS#8 EC with a number": lambda: pkcs8(EC_OID, number(32)),
    "eight numbers": lambda: der(0x30, b"".join(number(64) for _ in range(8))),
    "cut": lambda: pkcs1()[:-1],
    "one byte more": lambda: pkcs1() + b"\0",
    "random": lambda: rng.randbytes(300),
}


def wrapped(text, width, end="\n"):
    return end.join(text[i : i + width] for i in range(0, len(text), width))


std = lambda x: base64.b64encode(x).decode()
FORMS = {
    "line": std, "line without padding": lambda x: std(x).rstrip("="), "url-safe": lambda x: base64.urlsafe_b64encode(x).decode(),
    "wrapped 64": lambda x: wrapped(std(x), 64), "wrapped 76, CRLF": lambda x: wrapped(std(x), 76, "\r\n"), "wrapped and indented": lambda x: wrapped(std(x), 64, "\n    "),
    "hex": bytes.hex, "upper-case hex": lambda x: x.hex().upper(),
    "PEM": lambda x: f"-----BEGIN PRIVATE KEY-----\n{wrapped(std(x), 64)}\n-----END PRIVATE KEY-----",
    "PEM on one line": lambda x: f"-----BEGIN RSA PRIVATE KEY-----{std(x)}-----END RSA PRIVATE KEY-----",
    "PEM with escaped line ends": lambda x: "-----BEGIN EC PRIVATE KEY-----\\n" + wrapped(std(x), 64, "\\n") + "\\n-----END EC PRIVATE KEY-----",
}
AROUND = [("", ""), ("KEY=", "\n"), ("é words before\n", "\nand after it"), ("key: ", " x"), ('"', '"')]


def keys(text):
    return [(a, b) for a, k, b in secretscan.scan(text) if secretscan.KINDS[k] == "key"]


@pytest.mark.parametrize("form", FORMS)
def test_planted_keys_are_found_whole(form):
    for name, make in KEYS.items():
        for before, after in AROUND:
            text = FORMS[form](make())
            assert keys(before + text + after) == [(len(before), len(before) + len(text))], (name, before)


def test_look_alikes_are_no_keys():
    found = [(name, form) for name, make in OTHERS.items() for form, put in FORMS.items() for _ in range(5) if keys(put(make()))]
    assert found == []


def test_several_keys_below_each_other():
    text = "\n".join(wrapped(std(make()), 64) for make in (pkcs1, sec1, ssh)) + "\n" + "A" * 64
    assert len(keys(text)) == 3


def test_pem_encryption():
    body = wrapped(std(bytes(range(160))), 64)
    frame = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: {}\n\n{}\n-----END RSA PRIVATE KEY-----"
    text = frame.format("AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", body)
    assert keys("x " + text) == [(2, 2 + len(text))]
    assert keys(frame.format("AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", wrapped(std(bytes(161)), 64))) == keys(frame.format("none", body)) == []


def test_hostile_texts_take_linear_time():
    texts = ["-----BEGIN PRIVATE KEY-----\n" * 16_000, "-----BEGIN PRIVATE KEY-----" + "A" * 2_000_000, "MIIE" * 300_000, ("M" + "A" * 63 + "\n") * 20_000, "a." * 500_000, "token " * 100_000, "-" * 1_000_000, "eyJ." * 200_000]
    for text in texts:
        start = time.perf_counter()
        secretscan.scan(text)
        assert time.perf_counter() - start < 3, text[:30]


def key_like(n, make):
    """Lines that each start like a key whose length leads to some later line's end."""
    rng = random.Random(1)
    return "\n".join(base64.b64encode(make(rng)).decode().rstrip("=").ljust(64, "A")[:64] for _ in range(n))


def test_key_like_lines_take_linear_time():
    ssh_head = b"openssh-key-v1\0" + (4).to_bytes(4, "big") + b"none" + (4).to_bytes(4, "big") + b"none" + bytes(4) + (1).to_bytes(4, "big") + (200).to_bytes(4, "big")
    der = lambda n: b"\x30\x82" + n.to_bytes(2, "big") + b"\x02\x01\x00\x02\x82" + (n - 100).to_bytes(2, "big")
    heads = [lambda r: ssh_head, lambda r: der(65_000), lambda r: der(48 * r.randint(10, 1300) - 4), lambda r: b"\x30\x82\xff\x00" + b"\x02\x00" * 22, lambda r: b"\x30\x82" + (48 * 400 - 4).to_bytes(2, "big") + b"\x30\x00" * 22]
    for head in heads:
        text = key_like(16_000, head)
        start = time.perf_counter()
        assert keys(text) == []
        assert time.perf_counter() - start < 1.5, text[:64]  # 1 MB


def test_key_between_key_like_lines():
    noise = key_like(40, lambda r: b"\x30\x82" + r.randint(300, 5000).to_bytes(2, "big") + b"\x02\x01\x00")
    for make in (pkcs1, sec1, ssh):
        body = wrapped(std(make()), 64)
        assert keys(noise + "\n" + body + "\n" + noise) == [(len(noise) + 1, len(noise) + 1 + len(body))], make


def test_token_behind_a_prefix():
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = ".".join((part(b'{"alg":"HS256"}'), part(b'{"sub":"x"}'), part(bytes(range(32)))))
    for prefix in ("sk_", "a-b_", "x_y_sk-"):
        assert [(a, b) for a, k, b in secretscan.scan("= " + prefix + token) if secretscan.KINDS[k] == "jwt"] == [(2 + len(prefix), 2 + len(prefix) + len(token))]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secretscan.digest(secretscan.secrets(none)).count() == 0
