"""Column functions for the record formats, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealstream.functions import values as V
from sealstream.functions.codecs import head, to_cbor


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- bytes, hex, digests ------------------------------------------------------

def sha256_hex(col) -> Column:
    return F.sha2(_c(col), 256)


def sha256_bytes(col) -> Column:
    return F.unhex(F.sha2(_c(col), 256))


def hex_lower(col) -> Column:
    return F.lower(F.hex(_c(col)))


def uint_be(col, width: int) -> Column:
    """Big-endian unsigned integer of ``width`` bytes."""
    return F.unhex(F.lpad(F.hex(_c(col).cast("bigint")), 2 * width, "0"))


def text_bytes(col) -> Column:
    return F.encode(_c(col), "UTF-8")


def utf8(col) -> Column:
    """Bytes as text; NULL where they are not UTF-8."""
    return F.try_validate_utf8(_c(col).cast("string"))


def json_quoted(col) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(_c(col).alias("a")))
    return whole.substr(F.lit(6), F.length(whole) - 6)


def is_hex(col, width: int) -> Column:
    return F.coalesce(_c(col).rlike(f"^[0-9a-f]{{{width}}}\\z"), F.lit(False))


def normalize_hex64(col) -> Column:
    col = _c(col)
    return F.when(col.rlike("^[0-9a-fA-F]{64}\\z"), F.lower(col))


def hex64_error(col) -> Column:
    """NULL when valid, else ``length:<n>`` or ``character:<0-based index>``."""
    col = _c(col)
    bad = F.regexp_instr(col, F.lit("[^0-9a-fA-F]"))
    return (
        F.when(F.octet_length(col) != 64, F.concat(F.lit("length:"), F.octet_length(col)))
        .when(bad > 0, F.concat(F.lit("character:"), bad - 1))
    )


def b64_or_null(col) -> Column:
    """Strict base64: standard alphabet, padded, no stray bits; NULL when invalid.

    Decoding tolerates blanks and stray bits, so the bytes must encode to the same text.
    Some sessions break base64() text into lines; those line ends are dropped first.
    """
    col = _c(col)
    raw = F.try_to_binary(col, F.lit("base64"))
    return F.when(F.translate(F.base64(raw), "\r\n", "") == col, raw)


def line_hash(col) -> Column:
    """Digest of a raw input line without its trailing CR/LF characters."""
    return F.sha2(F.regexp_replace(_c(col), r"[\r\n]+\z", ""), 256)


# --- deterministic CBOR over fixed shapes ---------------------------------------
#
# Arguments are SQL text (a column name or expression), so each item is one parsed
# expression; Python integers and texts become constant bytes.

def _head_sql(major: int, e: str) -> str:
    base = major << 5
    n = f"cast({e} as bigint)"
    # Past 2**63 the two's complement of value - 2**64 has the right bytes.
    wide = f"cast(if({e} > 9223372036854775807BD, {e} - 18446744073709551616BD, {e}) as bigint)"
    return (f"unhex(CASE WHEN {e} < 24 THEN lpad(hex({n} + {base}), 2, '0') "
            f"WHEN {e} < 256 THEN concat('{base + 24:02X}', lpad(hex({n}), 2, '0')) "
            f"WHEN {e} < 65536 THEN concat('{base + 25:02X}', lpad(hex({n}), 4, '0')) "
            f"WHEN {e} < 4294967296 THEN concat('{base + 26:02X}', lpad(hex({n}), 8, '0')) "
            f"ELSE concat('{base + 27:02X}', lpad(hex({wide}), 16, '0')) END)")


def _lit_sql(value) -> str:
    return f"X'{to_cbor(value).hex()}'"


def _text_sql(e: str) -> str:
    raw = f"encode({e}, 'UTF-8')"
    return f"concat({_head_sql(3, f'octet_length({raw})')}, {raw})"


def cbor_head(major: int, e: str | int) -> Column:
    """CBOR head for a non-negative integer of up to DECIMAL(20,0), shortest form."""
    return F.lit(head(major, e)) if isinstance(e, int) else F.expr(_head_sql(major, e))


def cbor_uint(e: str) -> Column:
    return cbor_head(0, e)


def cbor_int(e: str) -> Column:
    return F.expr(f"CASE WHEN {e} >= 0 THEN {_head_sql(0, e)} ELSE {_head_sql(1, f'(-1 - {e})')} END")


def cbor_text(e: str) -> Column:
    return F.expr(_text_sql(e))


def cbor_bytes(e: str) -> Column:
    return F.expr(f"concat({_head_sql(2, f'octet_length({e})')}, {e})")


def cbor_lit(value) -> Column:
    """Constant text, integer or null."""
    return F.lit(to_cbor(value))


def cbor_nullable(e: str, encoder=cbor_uint) -> Column:
    return F.coalesce(encoder(e), F.lit(b"\xf6"))


def concat_binary(col) -> Column:
    """Join an ARRAY<BINARY> into one BINARY (through hex text)."""
    return F.unhex(F.array_join(F.transform(_c(col), F.hex), ""))


def cbor_map(entries) -> Column:
    """Map of ``(key, already encoded value)`` in length-then-bytes key order."""
    ordered = sorted(entries, key=lambda kv: (len(kv[0].encode()), kv[0].encode()))
    parts = [cbor_head(5, len(ordered))]
    for key, value in ordered:
        parts += [cbor_lit(key), value]
    return F.concat(*parts)


def cbor_text_array(e: str) -> Column:
    """Array of equal-length hex digests encoded as CBOR text items."""
    return F.expr(f"concat({_head_sql(4, f'size({e})')}, unhex(array_join("
                  f"transform({e}, h -> concat('7840', hex(encode(h, 'UTF-8')))), '')))")


def record_v2(pod_id: str, fc: str, ingest_time: str, device_time: str | None, kind: str,
              payload: Column) -> Column:
    """Seven-element canonical record; ``pod_id`` is bytes, ``payload`` already encoded."""
    at = F.lit(b"\xf6") if device_time is None else cbor_nullable(device_time)
    return F.concat(F.lit(b"\x87\x01"), cbor_bytes(pod_id), cbor_uint(fc), cbor_uint(ingest_time),
                    at, cbor_uint(kind), payload)


# --- identifiers ------------------------------------------------------------------

def pod_id_bytes(col) -> Column:
    return uint_be(col, 8)


def pod_id_hex(col) -> Column:
    return F.lower(F.lpad(F.hex(_c(col).cast("bigint")), 16, "0"))


def dev_id_of(pod_hex) -> Column:
    """Frame device id: last two bytes of the hex pod id."""
    return F.conv(F.substring(_c(pod_hex), 13, 4), 16, 10).cast("int")


def framed_nonce(salt8, fc, tail8) -> Column:
    return F.concat(_c(salt8), uint_be(fc, 8), _c(tail8))


def frame_aad(dev_id, msg_type, flags) -> Column:
    return F.concat(uint_be(dev_id, 2), uint_be(msg_type, 1), uint_be(flags, 1))


def entity_id(kind: str, *cols, prefix: str = "vt") -> Column:
    """``<prefix>:<kind>:sha256(kind 0x1f c1 0x1f c2 ...)``; NULL when a part is NULL."""
    parts = [F.lit(kind)]
    for col in cols:
        parts += [F.lit("\x1f"), _c(col)]
    return F.concat(F.lit(f"{prefix}:{kind}:"), F.sha2(F.concat(*parts), 256))


def derived_sensor_key(identity, prop, channel) -> Column:
    suffix = F.coalesce(F.concat(F.lit("ch"), _c(channel).cast("string")),
                        F.replace(_c(prop), F.lit("_"), F.lit("-")))
    return F.concat(F.lit("prov-"), F.substring(F.sha2(_c(identity), 256), 1, 16),
                    F.lit("-"), suffix)


def disclosure_label(col) -> Column:
    out = _c(col)
    for code, label in V.DISCLOSURE_LABELS:
        out = F.when(_c(col) == code, F.lit(label)).otherwise(out)
    return out


# --- time ---------------------------------------------------------------------------

_RFC3339 = (r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d"
            r"(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z")


def parse_rfc3339(col) -> Column:
    """Unix seconds, or NULL when the text is not a valid RFC 3339 timestamp."""
    col = _c(col)
    text = F.when(col.rlike(_RFC3339), col)

    def part(at: int) -> Column:
        return F.substring(text, at, 2).try_cast("bigint")

    days = F.datediff(F.substring(text, 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date"))
    local = days.cast("bigint") * 86400 + part(12) * 3600 + part(15) * 60 + part(18)
    zone = F.substring(text, -6, 6)
    off = (F.substring(zone, 2, 2).try_cast("bigint") * 3600
           + F.substring(zone, 5, 2).try_cast("bigint") * 60)
    return local - (F.when(text.endswith("Z"), F.lit(0)).when(zone.startswith("-"), -off).otherwise(off))


def utc_text(col) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of unix seconds; a zone-free timestamp ignores the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", _c(col).cast("bigint"), epoch).cast("string")


def format_rfc3339(col) -> Column:
    """UTC text with second precision, independent of the session time zone."""
    return F.concat(F.translate(utc_text(col), " ", "T"), F.lit("Z"))


def utc_day(col) -> Column:
    """``yyyy-MM-dd`` of unix seconds."""
    return F.substring(utc_text(col), 1, 10)


# --- JSON guards, paths, text checks ---------------------------------------------------

def json_item(variant, path: str) -> Column:
    """Item at ``path`` of a VARIANT; NULL when absent (a JSON null is an item)."""
    return F.try_variant_get(_c(variant), path, "variant")


def json_type(variant, path: str) -> Column:
    """Type at ``path`` of a VARIANT (``OBJECT<..>``, ``BIGINT``, ``STRING``, ...), NULL when absent."""
    return F.schema_of_variant(json_item(variant, path))


def json_uint(variant, path: str, maximum: int) -> Column:
    """Unsigned integer at ``path``; NULL for booleans, texts, fractions, out of range."""
    n = F.try_variant_get(_c(variant), path, "bigint")
    return F.when((json_type(variant, path) == "BIGINT") & n.between(0, maximum), n)


def json_text(variant, path: str) -> Column:
    return F.when(json_type(variant, path) == "STRING",
                  F.try_variant_get(_c(variant), path, "string"))


def portable_path(col, version: int = 1) -> Column:
    col = _c(col)
    if version == 1:
        return ~col.rlike(r"^/|(^|/)\.\.(/|\z)")
    return (F.length(col) > 0) & ~col.rlike(
        r"^/|\\|:|[\x00-\x1f\x7f-\x{9f}]|^\.(/|\z)|(^|/)\.\.(/|\z)")


def clean_path(col) -> Column:
    """Path without empty and ``.`` parts, each ``..`` taking away the part before it, of any depth."""
    col = _c(col)
    none = F.array().cast("array<string>")
    up = lambda done: (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
    parts = F.aggregate(F.split(col, "/"), none, lambda done, part: F.when(part.isin("", "."), done).when(
        (part == "..") & up(done), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part))))
    cleaned = F.concat(F.when(col.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(~col.rlike(r"(^|/)\.{0,2}(/|\z)"), col).otherwise(cleaned)  # most paths have no such part


def idempotency_key_ok(col) -> Column:
    col = _c(col)
    return F.octet_length(col).between(1, 255) & ~col.rlike(r"[\x00-\x1f\x7f-\x{9f}]")


# --- block headers -----------------------------------------------------------------------

def reverse_bytes(col) -> Column:
    """Byte order reversed: reverse the hex text, then swap back each digit pair."""
    return F.unhex(F.regexp_replace(F.reverse(F.hex(_c(col))), "(.)(.)", "$2$1"))


def block_hash(header) -> Column:
    """Display order hash: reversed double SHA-256 of an 80-byte header."""
    return hex_lower(reverse_bytes(sha256_bytes(sha256_bytes(header))))


def compact_target(bits) -> Column:
    """256-bit target as 64 hex digits; NULL when zero, negative or too wide."""
    bits = _c(bits).cast("bigint")
    exponent = F.shiftright(bits, 24)
    mantissa = bits.bitwiseAND(F.lit(0x7FFFFF))
    small = F.lpad(F.hex(F.floor(mantissa / F.pow(F.lit(256), 3 - exponent)).cast("bigint")), 64, "0")
    wide = F.concat(F.hex(mantissa), F.repeat(F.lit("00"), (exponent - 3).cast("int")))
    # A target past 256 bits admits every hash.
    body = (F.when(exponent <= 3, small).when(F.length(wide) <= 64, F.lpad(wide, 64, "0"))
            .otherwise(F.lit("f" * 64)))
    bad = (mantissa == 0) | (bits.bitwiseAND(F.lit(0x800000)) != 0)
    return F.when(~bad, F.lower(body))


def pow_ok(header) -> Column:
    bits = F.conv(F.hex(reverse_bytes(F.substring(_c(header), 73, 4))), 16, 10).cast("bigint")
    return block_hash(header) <= compact_target(bits)


def ascii_trim(col) -> Column:
    """Trim ASCII whitespace from both ends of text."""
    return F.regexp_replace(_c(col), r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")


def first_failure(checks) -> Column:
    """Name of the first failing check; ``checks`` is an ordered list of (name, failed)."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(list(checks)):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out
