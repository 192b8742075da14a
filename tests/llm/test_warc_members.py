"""Damaged gzip members that hold many records."""

import zlib

import pytest

from tablewright.llm import warc

from .test_warc_chat import archive, found


def one_member(n=40, level=6, seed=9):
    payloads, units = archive(n, seed)
    return payloads, [zlib.decompress(u, 31) for u in units], level


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("place", ["before", "alone", "between"])
def test_one_wrong_record_of_many(level, place):
    payloads, plain, _ = one_member()
    k = next(i for i in range(10, 40) if len(payloads[i]) > 50)
    hurt = [*plain[:k], plain[k][:-10] + bytes([plain[k][-10] ^ 1]) + plain[k][-9:], *plain[k + 1 :]]
    more = warc.member(warc.record(99, "u", b"more", __import__("hashlib").sha256(b"more").hexdigest(), None, False))
    member = warc.member(b"".join(hurt), level)
    data = {"before": member + more, "alone": member, "between": more + member + more}[place]
    records, gaps = found(data)
    assert [r for r in records if r[0] != 99] == [(i, p) for i, p in enumerate(payloads) if i != k]
    assert len([r for r in records if r[0] == 99]) == data.count(more)
    start = len(more) if place == "between" else 0
    assert gaps == [(start, start + len(member))]


@pytest.mark.parametrize("level", [0, 6])
def test_wrong_checksum_keeps_the_records(level):
    payloads, plain, _ = one_member()
    member = bytearray(warc.member(b"".join(plain), level))
    member[-8] ^= 1
    next_payloads, next_units = archive(3, 2)
    records, gaps = found(bytes(member) + b"".join(next_units))
    assert records == [*enumerate(payloads), *enumerate(next_payloads)]
    assert gaps == [(0, len(member))]


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("damage", ["cut", "flip"])
def test_records_before_the_damage_stay(level, damage):
    payloads, plain, _ = one_member()
    member = warc.member(b"".join(plain), level)
    middle = len(member) // 2
    hurt = member[:middle] if damage == "cut" else member[:middle] + bytes([member[middle] ^ 0x55]) + member[middle + 1 :]
    next_payloads, next_units = archive(3, 2)
    records, gaps = found(hurt + b"".join(next_units))
    assert records[-3:] == list(enumerate(next_payloads))
    saved = records[:-3]
    assert len(saved) >= 12 and all(payloads[i] == p for i, p in saved) and len({i for i, _ in saved}) == len(saved)
    assert [i for i, _ in saved][:12] == list(range(12))
    assert gaps[0][0] == 0 and gaps[-1][1] == len(hurt)
