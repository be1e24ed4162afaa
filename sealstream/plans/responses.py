"""Encoded timestamp responses, as inputs of the queries: a template per kind of response, with a place for the digest."""

from __future__ import annotations

from sealstream.functions import tokens as K

HOLE = b"\xab" * 32  # where the digest of an artifact goes


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    width = (n.bit_length() + 7) // 8
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([128 + width]) + n.to_bytes(width, "big")) + body


def oid(text: str) -> bytes:
    first, second, *rest = (int(x) for x in text.split("."))
    body = b""
    for n in (40 * first + second, *rest):
        digits = [n & 127]
        while n := n >> 7:
            digits.append(n & 127 | 128)
        body += bytes(reversed(digits))
    return der(0x06, body)


def number(n: int, tag: int = 0x02) -> bytes:
    return der(tag, n.to_bytes(n.bit_length() // 8 + 1, "big"))


NAME = der(0x30, der(0x31, der(0x30, oid("2.5.4.3"), der(0x0C, b"Clock"))))


def certificate(serial: int) -> bytes:
    return der(0x30, der(0x30, der(0xA0, number(2)), number(serial), der(0x30, oid("1.2.3")), NAME, b"\x05\x00" * 70))


def response(status: int = 0, policy: str = "1.2.3", algorithm: str = "2.16.840.1.101.3.4.2.1", accuracy: dict | None = None,
             certificates: tuple = (7, 8), signer: int = 7) -> bytes:
    """A response over the digest ``HOLE``; ``accuracy`` maps tags to numbers."""
    info = [number(1), oid(policy), der(0x30, der(0x30, oid(algorithm)), der(0x04, HOLE)), number(300), der(0x18, b"20240301000500Z")]
    if accuracy:
        info.append(der(0x30, *[number(v, t) for t, v in accuracy.items()]))
    signed = der(0x30, number(3), der(0x31), der(0x30, oid(K.TST_INFO), der(0xA0, der(0x04, der(0x30, *info)))),
                 der(0xA0, *[certificate(c) for c in certificates]), der(0x31, der(0x30, number(1), der(0x30, NAME, number(signer)))))
    return der(0x30, der(0x30, number(status)), der(0x30, oid(K.SIGNED_DATA), der(0xA0, signed)))
