import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chiweave.llm.packing import pack, schedule
from chiweave.llm.queries import BPE
from chiweave.llm.token_files import TokenFile, read_places, write_token_files
from chiweave.llm.tokens import Encoder

LIB = Tokenizer.from_file(BPE)
ENCODE = Encoder(BPE, "<u4", max_words=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab,. .\n\t'sé<|endoftext|>1\x1c\x85日-_ẞ’!"), max_size=4))
def test_encoder_equals_the_library(texts):
    want = [np.array(e.ids, "<u4").tobytes() for e in LIB.encode_batch(texts, add_special_tokens=False)]
    assert ENCODE(texts) == want


def ids(text, end):
    return np.array(LIB.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark)


def test_files_round_trip(spark, docs, tmp_path):
    uri = f"file://{tmp_path}/files"
    manifest = write_token_files(docs, uri, BPE, length=64, rows=4)
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_places(manifest, uri).collect())
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at, want = 0, []
    for r in order:
        x = ids(r["text"], 2)
        want.append((at, -1 if r["doc_id"] is None else r["doc_id"], len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == sorted(want)


def test_sequences_have_equal_length_and_masks_hide_the_padding(spark, docs, tmp_path):
    uri = f"file://{tmp_path}/files"
    total = 0
    for r in write_token_files(docs, uri, BPE, length=64, rows=4).collect():
        f = TokenFile(uri, r["name"])
        seen = [f[i] for i in range(len(f))]
        assert all(len(a) == len(m) == 64 for a, m in seen)
        total += sum(int(m.sum()) for _, m in seen)
        assert sum(int(m.sum()) for _, m in seen) == r["n_tokens"]
        assert f[0][0].base is not None  # a view of the file, no copy
    assert total == sum(len(ids(r["text"], 2)) for r in docs.select("text").collect())


def test_no_rows_no_files(spark, docs, tmp_path):
    uri = f"file://{tmp_path}/none"
    assert read_places(write_token_files(docs.limit(0), uri, BPE), uri).count() == 0


def expand(counts, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, g in enumerate(gaps) if g >= length]
            if fit:
                i = min(fit, key=lambda i: gaps[i])
                gaps[i] -= length
            else:
                gaps.append(capacity - length)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 25), max_size=12))
def test_schedule_is_valid_and_uses_as_few_sequences_as_best_fit(counts):
    plan = schedule(counts, 40)
    filled, spans, n = Counter(), {}, Counter()
    for length, lo, hi, first, each, offset in plan.tolist():
        for r in range(lo, hi):
            s, at = first + (r - lo) // each, offset + length * ((r - lo) % each)
            filled[s] += length
            spans.setdefault(s, []).append((at, at + length))
            n[length] += 1
    assert n == Counter(counts)
    for s, parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] <= 40
    assert len(spans) == expand(counts, 40)


def test_pack_keeps_every_id(spark, docs):
    rows = pack(docs, BPE, capacity=128).collect()
    want = sorted(zlib.crc32(ids(r["text"], 0).tobytes()) for r in docs.select("text").collect())
    by_doc = {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 512
        by_doc.setdefault(r["doc_id"], []).append(r)
    single = [zlib.crc32(b"".join(bytes(p["ids"]) for p in sorted(v, key=lambda p: p["piece"]))) for k, v in by_doc.items() if k != 28]
    assert set(single) <= set(want) and len(single) == len(want) - 2
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 128
    assert all(r["length"] == 128 for r in rows if r["piece"] > 0)
    assert pack(docs.limit(0), BPE).count() == 0
