import hashlib

from pyspark.sql import functions as F

from sealstream.functions import tokens as K
from sealstream.operators import evidence as E


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def oid(text):
    arcs = [int(x) for x in text.split(".")]
    out = b""
    for n in [arcs[0] * 40 + arcs[1], *arcs[2:]]:
        digits = [n & 127]
        while n := n >> 7:
            digits.append(n & 127 | 128)
        out += bytes(reversed(digits))
    return der(6, out)


def num(n, tag=2):
    return der(tag, n.to_bytes(n.bit_length() // 8 + 1, "big"))


ISSUER = der(0x30, der(0x31, der(0x30, oid("2.5.4.3"), der(0x0C, b"Test CA"))))


def cert(serial):
    return der(0x30, der(0x30, der(0xA0, num(2)), num(serial), der(0x30, oid("1.2.3")), ISSUER, b"\x05\x00" * 90))


def token(status=0, policy="1.2.3.4", sha="ab" * 32, accuracy=None, when=b"20240301000500Z", certs=(7, 8), signer=7):
    parts = [num(1), oid(policy), der(0x30, der(0x30, oid("2.16.840.1.101.3.4.2.1")), der(4, bytes.fromhex(sha))), num(300), der(0x18, when)]
    if accuracy:
        parts.append(der(0x30, *[num(v, t) for t, v in accuracy.items()]))
    info = der(0x30, *parts)
    signed = der(0x30, num(3), der(0x31), der(0x30, oid(K.TST_INFO), der(0xA0, der(4, info))),
                 der(0xA0, *[cert(c) for c in certs]), der(0x31, der(0x30, num(1), der(0x30, ISSUER, num(signer)))))
    return der(0x30, der(0x30, num(status)), der(0x30, oid(K.SIGNED_DATA), der(0xA0, signed)))


def test_register_checks_on_decoded_tokens(spark):
    sha = "ab" * 32
    pin = hashlib.sha256(cert(7)).hexdigest()
    cases = [("good", token(accuracy={2: 1, 0x80: 500, 0x81: 999}), None), ("status", token(status=2), "status"),
             ("policy", token(policy="1.2.3.5"), "policy"), ("imprint", token(sha="cd" * 32), "imprint"),
             ("accuracy", token(accuracy={0x80: 1000}), "accuracy"), ("signer", token(signer=8), "signer")]
    df = spark.createDataFrame([(n, bytearray(t)) for n, t, _ in cases], "name string, response binary")
    df = K.decode_tokens(df).withColumns({"artifact_sha256": F.lit(sha), "expected_policy_oid": F.lit("1.2.3.4"),
                                          "expected_signer_sha256": F.lit(pin)})
    assert df.filter("malformed is not null").count() == 0
    assert {r.name: r.error for r in E.check_tokens(df).collect()} == {n: e for n, _, e in cases}
    good = df.filter("name = 'good'").first()
    assert (good.gen_time, good.serial_hex, good.seconds, good.millis, good.micros) == (1709251500, "12c", 1, 500, 999)


def test_malformed_tokens(spark):
    good = token()
    cases = [b"", good[:-1], good + b"\x00", token(certs=()), token(certs=(7, 7)), token(signer=9), token(when=b"20240230000000Z"),
             token(when=b"2024030100050Z"), token(certs=range(1, 10)), b"\x30\x80\x00\x00"]
    df = K.decode_tokens(spark.createDataFrame([(bytearray(c),) for c in cases], "response binary"))
    assert df.filter("malformed is null").count() == 0
