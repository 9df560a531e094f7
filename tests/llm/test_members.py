"""Salvage within gzip members that hold several records."""

import random
import zlib

from docloom.llm import warc

RNG = random.Random(2)
RECORDS = [warc.record_bytes(f"urn:page:{i}", "http://a/", RNG.randbytes(3000).hex().encode(), None) for i in range(8)]


def member(parts, level=6):
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"".join(parts)) + z.flush()


def found(data):
    got = list(warc.salvage(data))
    return [int(x[2]["record_id"].rpartition(":")[2]) for x in got if x[2]], [x for x in got if x[2] is None]


def broken(i):
    return RECORDS[i].replace(b"Block-Digest: sha1:", b"Block-Digest: sha1:X")


def test_bad_record_inside_a_sound_member():
    for hurt in ([0], [3], [7], [0, 1, 5]):
        parts = [broken(i) if i in hurt else RECORDS[i] for i in range(8)]
        records, gaps = found(member(parts))
        assert records == [i for i in range(8) if i not in hurt] and len(gaps) == 1
    records, gaps = found(member([broken(0), RECORDS[1]]) + member(RECORDS[2:4]))
    assert records == [1, 2, 3] and len(gaps) == 1


def test_member_that_fails_gives_what_inflates():
    whole, after = member(RECORDS[:6]), member(RECORDS[6:])
    records, gaps = found(whole[: len(whole) * 2 // 3])
    assert records == [0, 1, 2] and len(gaps) == 1
    wrong_sum = bytearray(whole)
    wrong_sum[-6] ^= 255
    records, gaps = found(bytes(wrong_sum) + after)
    assert records == [0, 1, 2, 3, 4, 6, 7] and len(gaps) == 1 and gaps[0][1] == len(whole)
    torn = bytearray(whole)
    torn[len(torn) // 2 : len(torn) // 2 + 400] = b"\xff" * 400
    records, gaps = found(bytes(torn) + after)
    assert records[:2] == [0, 1] and records[-2:] == [6, 7] and gaps
    plain = bytearray(member(RECORDS[:6], 0))
    plain[plain.index(b"urn:page:3") + 2000] ^= 255
    records, _ = found(bytes(plain) + after)
    assert sorted(records) == [0, 1, 2, 4, 5, 6, 7]
