import base64

from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.functions import proofs as P
from sealstream.operators import bundles as B
from sealstream.operators import evidence as E

# A published proof of a text file and the header it attests to.
HELLO = base64.b64decode(
    "AE9wZW5UaW1lc3RhbXBzAABQcm9vZgC/ieLohOiSlAEIA7ogTlDRJuRnTABeBNguhMITZngK8fQ71Uo3gWtqs0AD8cgBAQAAAAHkgvnTLsw7ple2nYmA"
    "EIV7VEV6kEl5gv9W+XxOxY5vmAEAAABrSDBFAiEAslOt0dHPkIRDOKR1oE/xP8nnvSQrB3Yt6gf1YIst42cCIACyaMqcM0KzdpzdBiiRMXzc74eqwxC2"
    "hV6dk4mOu+jsASECDY5NEH0rM5sAUO/dS0oJJFqgVgSPElOWN06moqsHCcb/////AmUz5gUAAAAAGXapFAvwV9QPu6Z0SGJRX1tVojEN5XcviKyghgEA"
    "AAAAABl2qRTwBoisAAAAAAgI8SCph/cWxTORPDFMeONdNYhMrJQ/pCysSdKyxp9AA/hfiAgI8SDexVs0h+Hj9yKkm1WneDIVhieF9KOss5KEYBn3HcZK"
    "nQgI8SCyyhj0heCAR44CXas9RktBbA4ey2Ypya786MghTQQkMggI8CARsOkGYRlv9LCBPD7aFBurXpFgSDe996DJ3zfbDjoRmAgI8CDDS8GkoQk//RSM"
    "AWseZkdCkU6Tnvq+TT01ZRWRSybZ4ggI8CDD5ufDjGn2ryTCvjTrrEglft5h7AohuVNeREMne+MGRggI8SAHmL+GBuAAJOXV1UvwyWD2Kd+52taRV0Vb"
    "byZSwOjegQgI8CA/mtptYLqiRABrsKrVFEitL6+51LZIegmZz/JrkfD1NggI8SDHAwGelZqN0/rvdIm7MoukhVdHWOcJHwFGTrZYcsl1yAgI8CDL/v/1"
    "E/+EuRXj/tb515lnZjD4Nk6ipsdVf62UpbXXiAgI8SAL4jcJhZkTur1EYLvd+O0hPnyHc6Sx+s4w+Kz98JO3BQgIAAWIlg1z1xkBA/fvFQ==")
DIGEST = "03ba204e50d126e4674c005e04d82e84c21366780af1f43bd54a37816b6ab340"
ROOT = "8a1b66ecb7cbd07d8139a7e7d7f2c41aab1f5009b8364aaf61d03ad245e47e00"
PENDING = P.PENDING_TAG + b"\x06\x05a.b/c"


def proof(body, digest=bytes(32)):
    return P.MAGIC + b"\x01\x08" + digest + body


def test_published_proof(spark):
    error, native, digest, uris, heights, messages, steps = P.read_proof(HELLO, DIGEST)
    if error is None and not heights:
        assert native is False  # this build has no RIPEMD-160
        return
    assert (error, native, digest, uris, heights) == (None, False, DIGEST, [], [358391])
    df = spark.createDataFrame([("a", 358391, messages[0])], "anchor_id string, height long, message string")
    headers = spark.createDataFrame([(358391, ROOT)], "height long, merkle_root string")
    assert E.uncovered_heights(df, headers).count() == 0


def test_errors():
    def err(raw, want=None):
        return P.read_proof(raw, want)[:2]
    assert err(b"nothing") == (None, False)
    assert err(proof(b"\x00" + PENDING)) == (None, True)
    assert err(proof(b"\x00" + PENDING) + b"x") == ("ots-proof-trailing-garbage", True)
    assert err(proof(b"\x08" * 300)) == ("ots-proof-recursion-limit", True)
    assert err(proof(b"\x08")) == ("ots-proof-parse-failed", True)
    assert err(proof(b"\x00" + PENDING), "zz") == ("ots-expected-hash-invalid", True)
    assert err(proof(b"\x00" + PENDING), "0" * 64) == (None, True)
    assert err(proof(b"\x00" + P.PENDING_TAG + b"\x03\x02a?")) == ("ots-pending-uri-invalid", True)
    assert err(proof(b"\xf0\x01a\x00" + P.HEIGHT_TAG + b"\x01\x05")) == ("ots-bitcoin-digest-invalid", True)
    assert err(proof(b"\xf0" + b"\x81\x20" + b"a" * 4097)) == ("ots-proof-parse-failed", True)
    huge = b"\xff" * 9 + b"\x01"
    assert err(proof(b"\x00" + P.HEIGHT_TAG + b"\x0a" + huge)) == ("ots-proof-parse-failed", True)  # past any bigint
    assert err(proof(b"\xff\x00" + PENDING + b"\x08\x00" + P.HEIGHT_TAG + b"\x01\x05")) == (None, True)


def test_triage(spark):
    sha = "ab" * 32
    rows = [("missing", None, sha), ("stub", f"STATIONARY-OTS:{sha.upper()}\nrest".encode(), sha), ("bad", f"STATIONARY-OTS:{'0' * 64}".encode(), sha),
            ("place", b"\n OTS_PROOF_PLACEHOLDER\t", sha), ("pend", proof(b"\x00" + PENDING), None),
            ("height", proof(b"\x00" + P.HEIGHT_TAG + b"\x01\x05"), None), ("text", b"STATIONARY-OTS:short", sha)]
    df = spark.createDataFrame([(a, None if b is None else bytearray(b), c) for a, b, c in rows], "id string, proof binary, expected_sha256 string")
    got = {r.id: (r.status, r.reason) for r in B.triage_proofs(B.parse_proofs(df), True).collect()}
    assert got == {
        "missing": ("missing", "ots-proof-not-found"), "stub": ("pending", "stationary-stub-accepted"),
        "bad": ("failed", "stationary-stub-hash-mismatch"), "place": ("pending", "placeholder-accepted"),
        "pend": ("pending", "ots-pending-attestation"), "height": ("failed", "ots-binary-not-found"), "text": ("failed", "ots-binary-not-found")}
    strict = {r.id: r.reason for r in B.triage_proofs(B.parse_proofs(df), False).collect()}
    assert strict["stub"] == strict["place"] == "placeholder-not-allowed"


def test_targets(spark):
    df = spark.createDataFrame([(0x1D00FFFF,), (0x01120000,), (0x03123456,), (0x04923456,), (0,), (0x20123456,), (0x22123456,)], "b long")
    got = [r[0] for r in df.select(C.compact_target("b")).collect()]
    def py(bits):
        e, m = bits >> 24, bits & 0x7FFFFF
        if not m or bits & 0x800000:
            return None
        return f"{min(m >> 8 * (3 - e) if e <= 3 else m << 8 * (e - 3), 2**256 - 1):064x}"
    assert got == [py(r.b) for r in df.collect()]


def test_describe_function(spark):
    P.register_describe(spark)
    spark.createDataFrame([(bytearray(proof(b"\x08\x00" + PENDING)),)], "p binary").createOrReplaceTempView("one_proof")
    rows = spark.sql("SELECT step FROM one_proof, LATERAL describe_proof(p) ORDER BY step_no").collect()
    assert [r.step for r in rows] == ["sha256", "verify PendingAttestation(a.b/c)"]
