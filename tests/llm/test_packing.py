"""Packing: exact pieces, valid sequences, few of them."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from corpusengine.llm import packing
from corpusengine.llm.queries import packing_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing_tokenizer())
    t.encode_special_tokens = True
    return t


TEXTS = [
    "", None, "Hello, world's END", "naïve Café ́x  y", "tab\tline\nfeed\x0bvt\x0cff nbsp ideographic　x\x85nel",
    "<|endoftext|> a<|startoftext|>b", "é" * 300 + " " + "word" * 400, "1234567 12 3.5 $$$ *** it's we're",
    "\x1c sep \x1d\x1e\x1f", "日本語 テスト 한국어", "the cat " * 3000, "x" * 9000,
]


def test_chunks_encode_like_the_whole_text(tokenizer):
    encoder = packing.ChunkEncoder(packing_tokenizer(), memo_strings=50)
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "́", "'s", "'", " ", "\n", "9", "<|endoftext|>", "日", "--", "\u00a0", "İ", "Σ", "J\u030c", "T", ".", "word", "ª", "٣", "ー", "!?", "\u0345", "ﬁ"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    for at in range(0, len(texts), 7):
        own = texts[at:at + 7]
        ids, ends = encoder.encode(pa.array([None, *own], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [
            e.ids for e in tokenizer.encode_batch(own, add_special_tokens=False)]
    ids, ends = encoder.encode(pa.array(["x y", *texts, "z"], pa.string()).slice(1, 5))
    assert ids[:ends[0]].tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids and len(ends) == 5


def exact_bins(lengths, capacity):
    """Fewest sequences, by search over all assignments."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[i]:
                left = list(rooms)
                left.remove(room)
                place(i + 1, [*left, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(30))
def test_patterns_use_every_piece_and_few_sequences(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
    patterns = packing.pack_lengths(Counter(lengths), capacity)
    used = Counter()
    for pattern, times in patterns:
        assert 0 < sum(pattern) <= capacity and times > 0
        for x in pattern:
            used[x] += times
    assert used == Counter(lengths)
    assert sum(t for _, t in patterns) <= exact_bins(lengths, capacity) + 1


@pytest.mark.parametrize("seed", range(40))
def test_dominance_is_safe(seed):
    """What is fixed costs no sequence: fixed sets plus the optimum of the rest
    is the optimum of the whole."""
    rng = random.Random(100 + seed)
    capacity = rng.choice([12, 20, 25])
    lengths = [rng.randint(2, capacity) for _ in range(rng.randint(1, 9))]
    count = [0] * (capacity + 1)
    for x in lengths:
        count[x] += 1
    fixed = packing._fixed_by_dominance(count, capacity)
    rest = [x for x, n in enumerate(count) for _ in range(n)]
    assert sum(t for _, t in fixed) + exact_bins(rest, capacity) == exact_bins(lengths, capacity)


def test_large_instance_is_near_the_bound():
    rng = random.Random(3)
    counts = Counter(min(2047, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(50_000))
    n = sum(t for _, t in packing.pack_lengths(counts, 2048))
    bound = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert n <= 1.002 * bound + 1


def test_equal_lengths_make_one_pattern():
    assert packing.pack_lengths({900: 2_000_000}, 2048) == [((900, 900), 1_000_000)]
    assert sorted(packing.pack_lengths({900: 2_000_001}, 2048)) == [((900,), 1), ((900, 900), 1_000_000)]
    mid = packing.pack_lengths({a: 100_001 for a in range(683, 1024)}, 2048)
    assert len(mid) <= 2 * 341 and sum(t for _, t in mid) == -(-341 * 100_001 // 2)


def check(rows, texts, tokenizer, capacity):
    expected = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            expected[i, piece, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack_round_trip(spark, tokenizer, capacity):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (2, TEXTS[2]), (2, TEXTS[2])] + [(99, "one two")] * 40
    df = spark.createDataFrame([(i, t, 5, 1) for i, t in texts], "doc_id bigint, text string, length int, lo int").repartition(4)
    rows = packing.pack(df, packing_tokenizer(), capacity, with_ids=True).collect()
    n = check(rows, texts, tokenizer, capacity)
    total = sum(r.length for r in rows)
    assert n <= -(-total // capacity) + 2
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_empty_table(empty_docs):
    assert packing.pack(empty_docs, packing_tokenizer()).count() == 0
