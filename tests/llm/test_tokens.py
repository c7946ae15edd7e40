"""Encoders, token store, packing and BPE in SQL against the libraries."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe_sql, packing, token_store
from lodestone.llm.common import fresh_path, stored
from lodestone.llm.tokens import Encoder, encoder

from .conftest import ODD

STRANGE = ["a\n\nb", " a", "a ", "a  b", "a\tb \t c", "x\ny\nz", "\n", "I'll don't\nI'm", "q \u00a0 r", "Ünï\nçode \u0301x", "<|endoftext|>\nx", "ﬁ ＡＢ", "ǅ"]


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_the_library(file, kind, real):
    e = encoder(P.path(file), kind)
    for t in [*(t or "" for _, t in ODD), *STRANGE, *(r.text for r in real.limit(40).collect())]:
        for _ in range(2):  # once new, once known
            assert np.frombuffer(e.encode(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_on_odd_strings(file, kind):
    """Words are encoded one by one and remembered; whole texts must give what the library gives."""
    import random

    e = encoder(P.path(file), kind)
    rng = random.Random(11)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\u200b", "'s", "'LL", "a", "Bc", "é", "e\u0301", "ß", "İ", "ǆ", "東京", "😀", "👩\u200d💻", "ﬁ", "12", "3.4", "_", "--", "#!", "<|endoftext|>", "\x00", "\ufeff", "ก็", "नि"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(3000)]
    want = [x.ids for x in e.whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in texts] == want


def rows(docs):
    got = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    return sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_token_store(spark, odd, nothing, real):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for docs in (odd, nothing, real):
        path = fresh_path(spark, "tokens")
        token_store.write_tokens(docs, path, P.path("byte_bpe_50k.json"))
        got = token_store.with_checksums(token_store.read_tokens(spark, path)).collect()
        start, want = 0, []
        for i, t in rows(docs):
            ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_selective_reads(spark, real):
    path = fresh_path(spark, "tokens")
    token_store.write_tokens(real, path, P.path("byte_bpe_50k.json"))
    plan = token_store.read_tokens(spark, path, tokens=False).where("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert " tokens:" not in plan.split("ReadSchema")[1].replace(",", ", ").split("\n")[0] and "EqualTo(doc_id,7)" in plan


def check_packed(got, capacity):
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, odd, nothing, real):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for docs in (odd, nothing, real):
        got = packing.pack(stored(packing.token_pieces(docs, path), "pieces")).collect()
        want = []
        for i, t in rows(docs):
            ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), 4096):
                own = np.array(ids[k : k + 4096], "<u4")
                want.append((i is not None, i or 0, k // 4096, k, len(own), zlib.crc32(own.tobytes())))
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        used = check_packed(got, 4096)
        assert used <= -(-sum(r.length for r in got) // 4096) + 1


def test_local_search_saves_bins():
    sizes = [6, 6, 5, 5, 4, 4]  # best fit: 6 4 | 6 4 | 5 5
    assert len(packing.improve(sizes, [[0], [1], [2], [3], [4], [5]], 10)) == 3
    sizes = [5, 2, 6, 3, 4]  # 4 for 3, then 3 moves
    assert sorted(sorted(b) for b in packing.improve(sizes, [[0, 1], [2, 3], [4]], 10)) == [[0, 1, 3], [2, 4]]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 4096, 600).tolist()
    start = packing.best_fit(sizes, 4096)
    better = packing.improve(sizes, start, 4096)
    fill = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
    assert fill(better) >= fill(start) and len(better) <= len(start) and max(sum(sizes[i] for i in b) for b in better) <= 4096


def fewest_bins(sizes, capacity):
    """By trying everything."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i, r in enumerate(rooms):
            if r >= sizes[k] and r not in rooms[:i]:
                place(k + 1, rooms[:i] + [r - sizes[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_local_search_against_the_optimum():
    rng = np.random.default_rng(2)
    found, least, first = 0, 0, 0
    for _ in range(60):
        sizes = rng.integers(3, 30, 11).tolist()
        start = packing.best_fit(sizes, 40)
        got = packing.improve(sizes, start, 40)
        assert sorted(i for b in got for i in b) == list(range(11)) and max(sum(sizes[i] for i in b) for b in got) <= 40
        best = fewest_bins(sizes, 40)
        assert best <= len(got) <= len(start)
        found, least, first = found + len(got), least + best, first + len(start)
    assert found - least <= max(1, (first - least) // 2)


@pytest.mark.parametrize(("low", "high"), [(1, 4097), (700, 1500), (1300, 2048), (2049, 4097), (1500, 1501)])
def test_search_raises_squared_fill(low, high):
    sizes = np.random.default_rng(low).integers(low, high, 400).tolist()
    start = packing.best_fit(sizes, 4096)
    search = packing.Search(sizes, start, 4096)
    squares = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
    steps = 0
    for k in range(len(search.bins)):
        before = squares([*search.full, *search.bins])
        if search.relieve(k):
            steps += 1
            assert squares([*search.full, *search.bins]) > before
            assert (search.room >= 0).all() and [4096 - sum(sizes[i] for i in b) for b in search.bins] == search.room.tolist()
    assert steps or low != 700
    bins = packing.improve(sizes, start, 4096)
    assert sorted(i for b in bins for i in b) == list(range(400)) and len(bins) <= len(start) and squares(bins) >= squares(start)


def test_groups_are_mended(spark):
    """Many small groups, then their open bins together: as few sequences as the tokens allow."""
    rng = np.random.default_rng(1)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(1, 900, 3000))]
    pieces = stored(spark.createDataFrame(rows, packing.PIECES), "pieces")
    got = packing.pack(pieces, group=200).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(r[0], r[3]) for r in rows]
    assert check_packed(got, 4096) <= -(-sum(r[3] for r in rows) // 4096) + 1


def test_bpe_sql(spark, odd, nothing, real):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe_sql.read_ranks(path)) if t}, special_tokens={})
    for docs in (odd, nothing, real):
        got = bpe_sql.round_trip(docs, path).collect()
        want = []
        for i, t in rows(docs):
            ids = whole.encode_ordinary(t)
            want.append((repr(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert sorted((repr(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_bpe_sql_long_and_repeated_words():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    import tiktoken

    codec = bpe_sql.codec(path)
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe_sql.read_ranks(path)) if t}, special_tokens={})
    texts = ["a" * n for n in (63, 64, 65, 66, 999)] + ["ab" * 300, "mississippi" * 40, "=-" * 200, "thethe" * 33, "é" * 500]
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_bpe_sql_words_of_any_length():
    """Windows are joined exactly, whatever repeats in a word, and a megabyte without a break takes seconds."""
    import random
    import time

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe_sql.codec(path)
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe_sql.read_ranks(path)) if t}, special_tokens={})
    rng = random.Random(3)
    letters, runs = "abcdefghijklmnopqrstuvwxyz", ["a" * 37, "the", "na", "xyz", "=" * 5, "\u3000", "ab"]
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    texts = ["".join(rng.choices(letters, k=n)) for n in (64, 65, 95, 96, 97, 129, 700, 5000)]
    texts += [x * n for x in ("a", "ab", "abc", "aab", "the", "=-", "\u3000", " ", "\n", "é") for n in (33, 65, 100, 1001)]
    texts += ["".join(rng.choices(runs, k=n)) for n in (30, 300, 2000)] + ["".join(rng.choices("ab", k=3000)), cjk(2000)]
    began = time.time()
    texts += ["".join(rng.choices(letters, k=1_000_000)), "a" * 1_000_000, cjk(333_333)]
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() == whole.encode_ordinary(t) for x, t in zip(got, texts)] == [True] * len(texts)
    assert codec.decode(got) == [t.encode() for t in texts]
    assert time.time() - began < 240


def test_bpe_sql_windows_that_never_meet(monkeypatch):
    """Neighbours without a common token are contracted again as one."""
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe_sql.Codec(path)
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe_sql.read_ranks(path)) if t}, special_tokens={})
    monkeypatch.setattr(bpe_sql, "WINDOW", 10)  # five bytes on: runs of even tokens don't meet
    monkeypatch.setattr(bpe_sql, "WIDER", 3)
    monkeypatch.setattr(bpe_sql, "ROWS", 100)
    for t in ("a" * 500, "ab" * 300, "mississippi" * 30, "the" * 200, "=" * 401):
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == whole.encode_ordinary(t)
        assert codec.decode(codec.encode([t])) == [t.encode()]


def test_bpe_frames(spark, real):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    back = bpe_sql.decode(bpe_sql.encode(real.limit(5), path), path).collect()
    texts = {r.doc_id: r.text for r in real.limit(5).collect()}
    assert {r.doc_id: bytes(r.data).decode() for r in back} == texts


def test_encoder_new_words_take_one_memo():
    """A new word behind a space is made and kept once, alone or with a sign behind it."""
    path = P.path("byte_bpe_50k.json")
    own, whole = Encoder(path, "byte", 700), Tokenizer.from_file(path)
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=9)) for _ in range(2000)]
    for text in (" ".join(["x", *words]), " ".join(["x", *(f"{w}," for w in words)]), " ".join(["é", *(f"{w}.\n{w}" for w in words[:50]), "<|endoftext|>", "a'b", "q" * 90 + "!"])):
        assert array("I", own.encode(text)).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(own.memo) <= 701
    assert len(own.word) < 300  # 2,000 more before


def test_bpe_sql_looks_for_long_keys_among_new_ones():
    """Words that a worker knows are not gone through again for their lengths."""
    codec = bpe_sql.Codec(P.path("byte_bpe_multi_50k.tiktoken"))
    text = "one two " + "three" * 40
    assert codec.decode(codec.encode([text, "one two"])) == [text.encode(), b"one two"]
    codec.encode([text])
    assert codec.long == ["three" * 40] or codec.long == [" " + "three" * 40]
    assert not any(len(w) > bpe_sql.WINDOW for w in codec.young[0])
    codec.encode(["one two"])
    assert codec.long == []
    for most in (1, 5, 100):  # parts have all keys in order, and one key or at most so many bytes
        parts = list(bpe_sql._parts(["abc", "", "d" * 7, "ef", "g"], most))
        assert sum(parts, []) == ["abc", "", "d" * 7, "ef", "g"] and all(len(p) == 1 or sum(map(len, p)) <= most for p in parts)


def test_bpe_sql_decodes_rows_of_ids_and_contracts_at_once(monkeypatch):
    """Ids join the vocabulary in long rows, not word by word, and a small batch of words takes one run of the query."""
    codec = bpe_sql.Codec(P.path("byte_bpe_multi_50k.tiktoken"))
    made, table = [], codec._table
    monkeypatch.setattr(codec, "_table", lambda name, **columns: (made.append((name, columns)), table(name, **columns)))
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("etaoinshrdlué", k=rng.randrange(1, 29)))
    texts = ["", " ".join(word() for _ in range(3000)), "", "東京 " * 700, "\n", "x", " ".join(word() for _ in range(500)), ""]
    ids = codec.encode(texts)
    assert [name for name, _ in made] == ["seed"]
    made.clear()
    n = sum(map(len, ids)) // 4
    assert codec.decode(ids) == [t.encode() for t in texts]
    assert [(name, len(set(columns["p"].tolist()))) for name, columns in made] == [("pieces", -(-n // bpe_sql.PIECE))]
    assert all(isinstance(k, str) for known in codec.young for k in known)  # pieces took as much memory as words
    made.clear()
    monkeypatch.setattr(bpe_sql, "ROWS", 1000)
    monkeypatch.setattr(bpe_sql, "PIECE", 70)  # groups and batches end anywhere in a text
    assert codec.decode(ids) == [t.encode() for t in texts]
    assert [len(columns["id"]) for _, columns in made] == [1000] * (n // 1000) + [n % 1000] * (n % 1000 > 0)
    assert codec.decode([]) == [] and codec.decode([b"", b""]) == [b"", b""]
