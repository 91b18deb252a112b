"""Damage at the head of an archive."""

import random

import pytest

from seine.llm import op08_warc as w
from tests.llm.test_op08_warc import rec, whole


@pytest.mark.parametrize("hurt", [3, 1 << 17])
def test_zipped_archive_with_a_damaged_head(hurt):
    noise = random.Random(1)
    first = w.member(rec(0, "".join(chr(noise.randrange(33, 126)) for _ in range(300_000))))
    assert len(first) > 1 << 17
    rest = b"".join(w.member(rec(i, f"<p>{i}" * 20)) for i in range(1, 9))
    ids, gaps = whole(b"\0" * hurt + first[hurt:] + rest, True)
    assert ids == list(range(1, 9)) and len(gaps) == 1


def test_plain_archive_with_a_damaged_head_and_a_gzip_magic():
    first = rec(0, "x" * 50).replace(b"x" * 10, b"\x1f\x8b\x08" + b"x" * 7, 1)
    ids, gaps = whole(b"XXXX" + first[4:] + b"".join(rec(i, f"<p>{i}" * 20) for i in range(1, 9)), False)
    assert ids == list(range(1, 9)) and gaps
