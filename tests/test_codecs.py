import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from sealstream.functions import codecs as K
from sealstream.functions import columns as C
from sealstream.operators import admission as A
from sealstream.operators import ledger as L
from sealstream.operators import merkle as M

# Published facts, their CBOR digests, leaf order, root and day digest.
FACTS = [
    ('{"fc":1,"ingest_time":"2025-10-07T00:00:01Z","kind":"env.sample","payload":{"humidity_pct":45,"temperature_c":1.0},'
     '"pod_id":"pod-001","pod_time":"2025-10-07T00:00:00Z"}', "57dfb9693e09132384b45d84c174dc1816e7d54e5aeb42a484fc5c0118fea049"),
    ('{"fc":2,"ingest_time":"2025-10-07T00:05:01Z","kind":"env.sample","payload":{"humidity_pct":46,"temperature_c":1.5},'
     '"pod_id":"pod-001","pod_time":"2025-10-07T00:05:00Z"}', "168abce8b01931ed3e59aaf380cdf0a0706fa6c31c08dab65285b20a28842b8a"),
    ('{"fc":3,"ingest_time":"2025-10-07T00:10:01Z","kind":"power.sample","payload":{"battery_mv":3300,"energy_uj":100000.0},'
     '"pod_id":"pod-001","pod_time":"2025-10-07T00:10:00Z"}', "97358f1da38b74190dc6c033494bbc739c75e2ad427eb1fe4fd211332c6b207e"),
]
ROOT_V1 = "95f6c013cc5bc306a3b5bbb2484078b5491e36a8b0f4b32aab85d211ee562853"
DAY_SHA = "5bfc50a7dcab7b7908ff9740b5759abb8eac0bdae58147b41eb6b7c3a9fb7209"


def test_published_v1_vector(spark):
    df = spark.createDataFrame(FACTS, "text string, want string").withColumn("cbor", K.json_to_cbor("text"))
    assert df.filter(F.sha2("cbor", 256) != F.col("want")).count() == 0
    assert df.select(K.fact_error("vector")("cbor").alias("e")).filter("e is not null").count() == 0
    leaves = df.select(F.lit("an-001").alias("site_id"), F.lit("2025-10-07").alias("day"), M.leaf_hash_v1("cbor").alias("leaf"))
    block = L.build_block_headers(leaves).first()
    assert (block.merkle_root, block["count"], block.batch_id) == (ROOT_V1, 3, "an-001-2025-10-07-00")
    assert [r.leaf for r in L.block_leaves(leaves).orderBy("position").collect()] == sorted(f[1] for f in FACTS)
    assert L.digest_parts(L.day_parts(leaves), ["site_id", "day"]).first().sha256 == DAY_SHA


def test_canonical_json(spark):
    rows = [('{"b": [2, 1], "a": {"z": null, "y": true}}', '{"a":{"y":true,"z":null},"b":[2,1]}'),
            ('{"é": "ü", "e": 1.0}', '{"e":1.0,"é":"ü"}'), ("[1e16, 1e-7, 0.00001, 18446744073709551616]",
                                                             "[1e16,1e-7,0.00001,1.8446744073709552e19]"),
            ("{bad", None), ("[NaN]", None), ("1e999", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.filter(~K.canonical_json("t").eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("value,want", [
    (0.0, "f90000"), (-0.0, "f98000"), (1.0, "f93c00"), (1.5, "f93e00"), (65504.0, "f97bff"), (100000.0, "fa47c35000"),
    (5.960464477539063e-8, "f90001"), (1.1, "fb3ff199999999999a"), (-4.1, "fbc010666666666666"), (3.4028234663852886e38, "fa7f7fffff")])
def test_shortest_floats(value, want):
    assert K.float_bytes(value).hex() == want


def test_sql_heads_equal_python(spark):
    ns = [0, 23, 24, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = [bytes(r[0]) for r in df.select(C.cbor_head(3, "n")).collect()]
    assert got == [K.head(3, n) for n in ns]
    big = spark.sql("SELECT 18446744073709551615BD AS n")
    assert bytes(big.select(C.cbor_uint("n")).first()[0]) == K.head(0, 2**64 - 1)
    neg = spark.createDataFrame([(-1,), (-25,), (-70000,)], "n long")
    assert [bytes(r[0]) for r in neg.select(C.cbor_int("n")).collect()] == [K.to_cbor(n) for n in (-1, -25, -70000)]


def test_positional_floats(spark):
    df = spark.sql("""SELECT unhex('0000000000000007') pod_id, 5 fc, -3L ingest_time, cast(null as bigint) pod_time, 1 kind, 2 sample_type,
      10L start, 20L end, cast(null as float) value, cast(1.5 as float) min, cast('NaN' as float) max, cast(-2 as float) mean,
      cast(null as float) quality, 4 count, 9 sensor_channel, cast(null as binary) custom""")
    want = (bytes([0x87, 1, 0x48]) + bytes(7) + b"\x07\x05\x22\xf6\x01\x82\x00\x8b\x01\x02\x0a\x14\xf6"
            + b"\xfa" + struct.pack(">f", 1.5) + b"\xfa\x7f\xc0\x00\x00" + b"\xfa" + struct.pack(">f", -2) + b"\x04\xf6\x09")
    assert bytes(df.select(L.positional_cbor("custom")).first()[0]) == want


@pytest.mark.parametrize("raw,profile,error", [
    ("1801", "bundle", "not shortest form"), ("a2616201616101", "bundle", "map keys out of order"),
    ("a2616101616101", "record", "map keys out of order"), ("f93c00", "bundle", "simple or float value not allowed"),
    ("f93c00", "vector", None), ("fa3f800000", "vector", "float not shortest form"), ("c001", "record", "tag not allowed"),
    ("9f01ff", "record", "indefinite or reserved argument"), ("62c328", "record", "text is not UTF-8"),
    ("f7", "bundle", None), ("f7", "record", "simple or float value not allowed"), ("f818", "bundle", "not shortest form"),
    ("f820", "bundle", None), ("a10102", "bundle", None), ("a10102", "record", "map key is not text"),
    ("820180", "record", None), ("82a16161f6820102", "record", None), ("8201", "record", "truncated"), ("0000", "record", "trailing bytes"),
    ("fb7ff0000000000000", "vector", "non-finite float"), ("a1", "record", "truncated"), ("9bffffffffffffffff", "record", "truncated")])
def test_canonical_checks(spark, raw, profile, error):
    def run():
        data = bytes.fromhex(raw)
        return None if K.check_item(data, 0, profile) == len(data) else "trailing bytes"
    try:
        got = run()
    except K.CborError as exc:
        got = str(exc)
    assert got == error


def test_deep_nesting_needs_no_recursion():
    assert K.check_item(b"\x81" * 50000 + b"\x01", 0, "record") == 50001


def test_published_cipher_vector():
    # One XChaCha20-Poly1305 vector.
    key, aad = bytes(range(32)), bytes.fromhex("01230100")
    nonce = bytes.fromhex("0a0b0c0d0e0f1011000000000000002a0102030405060708")
    plain = bytes.fromhex("01040000002a02022710030209f6")
    (ct, tag), = K.seal([key], [nonce], [aad], [plain])
    assert ct.hex() == "008a5dcf21ef1d77017c4183ed82"
    assert tag.hex() == "f4105b97fa959fc0f68ada676aa4ed7e"
    assert K.unseal([key] * 2, [nonce] * 2, [aad, b"\x00" * 4], [ct] * 2, [tag] * 2) == [plain, None]


def test_records_read_together_equal_records_read_alone(spark):
    import random
    rnd = random.Random(4)

    def head(major, n):
        k = next(k for k in (0, 1, 2, 3) if n < 1 << (8 << k))
        return bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 24 + k]) + n.to_bytes(1 << k, "big")
    payloads = [b"\xf6", b"\xf5", b"\xf7", b"\xf4", head(0, 300), head(1, 5), head(3, 3) + b"abc", head(3, 2) + "é".encode(), head(3, 1) + b"\xff",
                head(2, 30) + bytes(30), b"\xa0", b"\x80", b"\xa1\x61a\x01", b"\xa2\x61b\x01\x61a\x01", b"\x18\x01", b"\xf9\x3c\x00", b"\xc0\x01", b"\x9f\xff"]
    rows = []
    for _ in range(3000):
        number = lambda: head(0, rnd.choice([0, 23, 24, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 1]))
        raw = b"\x87\x01\x48" + rnd.randbytes(8) + number() + number() + rnd.choice([b"\xf6", number()]) + number() + rnd.choice(payloads)
        if rnd.random() < 0.4:
            k = rnd.randrange(len(raw) + 1)
            raw = rnd.choice([raw[:k], raw + b"\0", raw[:k] + rnd.randbytes(1) + raw[k + 1:], raw[:k] + b"\x18" + raw[k:]])
        rows.append(raw)
    rows += [b"", b"\x87", None]

    def alone(raw):
        try:
            return (None, *K.read_record(raw)[1:])
        except K.CborError as exc:
            return (str(exc), None, None, None, None, None)
    df = spark.createDataFrame([(k, None if r is None else bytearray(r)) for k, r in enumerate(rows)], "k int, record binary").repartition(3)
    got = {r.k: tuple(r.m) for r in df.select("k", K.record_meta("record").alias("m")).collect()}
    want = {k: ("truncated", None, None, None, None, None) if r is None else alone(r) for k, r in enumerate(rows)}
    assert got == want
    assert sum(w[0] is None for w in want.values()) > 500 and len({w[0] for w in want.values()}) > 8


def test_poly1305_of_a_batch_equals_whole_numbers():
    import os

    import numpy as np

    def whole(key, msg):
        r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
        acc = 0
        for i in range(0, len(msg), 16):
            acc = (acc + int.from_bytes(msg[i:i + 16] + b"\x01", "little")) * r % ((1 << 130) - 5)
        return ((acc + int.from_bytes(key[16:], "little")) & ((1 << 128) - 1)).to_bytes(16, "little")
    sizes = [0, 1, 15, 16, 17, 31, 32, 64, 100, 255] * 20
    keys, msgs = [os.urandom(32) for _ in sizes], [os.urandom(n) for n in sizes]
    for key in (b"\xff" * 32, b"\x01" + bytes(15) + b"\xff" * 16, b"\x02" + bytes(31)):  # sums at and beyond the modulus
        for msg in (b"\xff" * 48, b"\xfb" + b"\xff" * 15, b"\xfb" + b"\xff" * 31, b"\xfa" + b"\xff" * 15, bytes(16)):
            keys.append(key)
            msgs.append(msg)
    got = K.poly1305(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 32), msgs)
    assert [g.tobytes() for g in got] == [whole(k, m) for k, m in zip(keys, msgs)]
    assert K.poly1305(np.empty((0, 32), np.uint8), []).shape == (0, 16)


@pytest.mark.parametrize("size", [1, 15, 16, 63, 64, 65, 128, 255, 256])
def test_cipher_round_trip(size):
    keys = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    nonces = [k[:24] for k in keys]
    plains = [(k * 8)[:max(1, size - i)] for i, k in enumerate(keys)]
    sealed = K.seal(keys, nonces, keys, plains)
    cts, tags = map(list, zip(*sealed))
    assert K.unseal(keys, nonces, keys, cts, tags) == plains


def test_postcard_fact_edges():
    fact = K.instant_plaintext(bytes(8), 300, -5, 250, 1.25)
    assert K.read_fact(fact, A.SAMPLE_CODES)[3:10] == (-5, 1, None, 250, -5, -5, 1.25)
    with pytest.raises(ValueError):
        K.read_fact(fact[:-1], A.SAMPLE_CODES)
    with pytest.raises(ValueError):
        K.read_fact(K.instant_plaintext(bytes(8), 1, 1, 99, 1.0), A.SAMPLE_CODES)


def test_block_header_values(spark):
    # A published header, its hash and Merkle root.
    header = ("02000000b96394585a281b7e5f438fd1c9ed492645a1fd61cb3802040000000000000000"
              "007ee445d23ad061af4a36b809501fab1ac4f2d7e7a739817dd0cbb7ec661b8a"
              "1e376755f58616186272def6")
    df = spark.createDataFrame([(header,)], "h string").select(F.unhex("h").alias("header"))
    row = df.select(C.pow_ok("header").alias("ok"), C.block_hash("header").alias("hash"),
                    C.hex_lower(C.reverse_bytes(F.substring("header", 37, 32))).alias("root")).first()
    assert row.ok
    assert row.hash == "000000000000000003e892881a8cdcdc117c06d444057c98b6f04a9ee75a2319"
    assert row.root == "8a1b66ecb7cbd07d8139a7e7d7f2c41aab1f5009b8364aaf61d03ad245e47e00"


@pytest.mark.parametrize("text,seconds", [
    ("2026-03-06T00:05:01Z", 1772755501), ("2026-03-06T01:05:01+01:00", 1772755501), ("2026-03-06T00:05:01.999Z", 1772755501),
    ("2024-02-29T00:00:00Z", 1709164800), ("2023-02-29T00:00:00Z", None), ("2026-03-06T24:00:00Z", None),
    ("2026-03-06 00:05:01Z", None), ("2026-03-06T00:05:01", None), ("2026-03-06T00:05:01.Z", None),
    ("2026-03-06T00:05:01Z\n", None), ("1969-12-31T23:59:59Z", -1),
    ("2024-03-10T02:30:00Z", 1710037800), ("2024-07-01T12:00:00Z", 1719835200), ("2024-11-03T06:30:00Z", 1730615400), ("2026-03-06T00:05:01-23:59", 1772841841)])
def test_times(spark, text, seconds):
    df = spark.createDataFrame([(text,)], "t string").select(C.parse_rfc3339("t").alias("s"))
    row = df.select("s", C.format_rfc3339("s").alias("f")).first()
    assert row.s == seconds
    if text.endswith("Z") and seconds is not None and "." not in text:
        assert row.f == text


def test_table_times_ignore_the_session_zone(spark):
    """02:30 does not exist in the session's zone on that day."""
    from sealstream.plans import telemetry as T
    df = spark.sql("SELECT 1L event_id, timestamp_ntz'2024-03-10 02:30:00.000007' ts, 3L user_id, 'view' event_type, 1.0D value")
    row = T.from_events(df).first()
    assert (row.ingest_time, row.t_ms, row.day) == (1710037800, 1710037800000, "2024-03-10")
