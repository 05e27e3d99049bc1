"""The blockwise order of suffixes against Python's sort, and the memory that a piece of text takes."""

import random
import subprocess
import sys

import numpy as np
import pytest

from lodestar.llm import suffixes


@pytest.mark.parametrize(("width", "sorted_"), [(1, 1 << 14), (1, 8), (8, 1 << 14), (8, 8)])
def test_buckets_are_in_byte_order(width, sorted_, monkeypatch):
    """Every suffix of a bucket stands where its bytes put it, within its distance to the sample."""
    monkeypatch.setattr(suffixes, "SORTED", sorted_)
    rng = random.Random(width)
    length, fragments, first, last, sample, gram = 20, [], [], [], [], []
    base = [rng.randbytes(width) for _ in range(60)]
    for i in range(30):
        text = list(base)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(60)] = rng.randbytes(width) if i % 2 else bytes(width)  # null bytes too
        a, z, s = rng.randrange(0, 5), rng.randrange(5, 12), 15
        fragments.append(b"".join(text[a : z + length]))
        first.append(a), last.append(z), sample.append(s), gram.append(i % 3)
    bucket = suffixes.Bucket(fragments, *(np.array(x, np.int64) for x in (first, last, sample, gram)), length, width)
    seen, repeats = [], {}
    for row, distance in bucket.blocks():
        strings = [fragments[r][(sample[r] - d - first[r]) * width :][: length * width] for r, d in zip(row, distance)]
        order = bucket.ordered(row, distance)
        keys = [(gram[row[k]], distance[k], strings[k]) for k in order]
        assert keys == sorted(keys)
        seen += zip(row.tolist(), distance.tolist())
        for k, hit in enumerate(bucket.repeated(row, distance)):
            repeats[row[k], distance[k]] = hit, (gram[row[k]], distance[k], strings[k])
    assert sorted(seen) == sorted((r, s - at) for r, (a, z, s) in enumerate(zip(first, last, sample)) for at in range(a, z + 1))
    times = {}
    for _, key in repeats.values():
        times[key] = times.get(key, 0) + 1
    assert all(hit == (times[key] > 1) for hit, key in repeats.values()) and any(n > 1 for n in times.values())


def test_substring_hashes_tell_strings_apart():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 2, 4000).astype(np.uint8)
    h = suffixes.Hashes(raw, 40, 12, 64)
    for n in (12, 40, 64):
        at = np.arange(len(raw) - n + 1)
        strings = [raw[i : i + n].tobytes() for i in at]
        assert len(set(h(at, n).tolist())) == len(set(strings))
    again = suffixes.Hashes(np.concatenate([raw[:7], raw]), 40, 12, 64)
    assert (again(np.arange(100) + 7, 40) == h(np.arange(100), 40)).all()


def test_a_piece_takes_little_memory():
    """Texts of 24 MB, hashed and cut in one process, add less than 120 MB to it."""
    code = """
import resource, random
import pyarrow as pa
from lodestar.llm import suffixes
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
rng = random.Random(1)
words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
text = " ".join(rng.choice(words) for _ in range(600_000))
texts = [text[i : i + 4000] for i in range(0, len(text), 4000)] + [text * 6]
b = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "hash", "text"])
for width, length, gram in ((1, 400, 128), (8, 51, 16)):
    before = peak()
    for out in suffixes._runs(length, gram, width)([b]):
        pass
    print(int(peak() - before))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    # The second run's text is held as bytes and as word hashes besides.
    one, two = map(int, out.stdout.split())
    assert one < 120 and two < 120, (one, two)
