"""Operators 1, 4 and 7 against the tokenizer libraries."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from weftgraph.llm import pretokenize as pre
from weftgraph.llm.bpe import ByteBPE, bpe_decode, bpe_encode, load_ranks, merge
from weftgraph.llm.slices import distinct_slices
from weftgraph.llm.tables import KeyTable, ListCache
from weftgraph.llm.token_counts import PieceModel, longest_prefix, prefix_token_counts, token_totals, total_tokens
from weftgraph.llm.token_files import LibraryEncoder, encoder, ids_crc32, read_tokens, write_tokens

RANKS, TOKENIZER, PIECES = (P.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABET = " \t\n'  a sS'tTmdrevl'lé 1²!~漢🙂 \u0085\x1c\x00　٣"
OWN = Tokenizer.from_file(TOKENIZER)
TEXT = st.text(st.one_of(st.sampled_from(ALPHABET), st.characters(exclude_categories=["Cs"])), max_size=40)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(RANKS)


def test_pattern_is_the_public_one():
    assert pre.PATTERN == P.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_encode_and_decode(texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})
    bpe = ByteBPE(RANKS)
    ids, offsets, per = bpe.encode(texts)
    want = [library.encode_ordinary(t) for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and per.tolist() == list(map(len, want))
    data, sizes = bpe.decode(ids, per)
    assert data.tobytes() == "".join(texts).encode() and sizes.tolist() == [len(t.encode()) for t in texts]
    at = np.split(offsets, np.cumsum(per)[:-1])
    assert all(list(a) == np.cumsum([0, *(bpe.size[i] for i in w)])[:-1].tolist() for a, w in zip(at, want))


def test_long_pieces_merge_alike(library, bpe):
    rng = random.Random(3)
    for n in (199, 200, 201, 1500):
        piece = "".join(rng.choice("abcé") for _ in range(n)).encode()
        assert merge(piece, bpe.ranks) == library.encode_ordinary(piece.decode())


def test_scan_composes_like_a_loop():
    rng = np.random.default_rng(1)
    gen, comp, by_state, _ = pre._monoid()
    f = gen[rng.integers(0, pre.SYMBOLS, 5000)]
    got, now = pre._scan(f, comp), 0
    for i, x in enumerate(f):
        now = comp[now * pre.WIDTH + int(x)]
        assert got[i] == now


def test_slices_survive_hash_collisions(monkeypatch):
    from weftgraph.llm import slices

    monkeypatch.setattr(slices, "_powers", lambda base, n: np.zeros(n, np.uint64))  # every hash is the length
    text = "ab cd ab ef"
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    which, first, _ = distinct_slices(cps, starts, ends)
    assert [text[starts[first[w]] : ends[first[w]]] for w in which] == ["ab", "cd", "ab", "ef"]


def test_bpe_on_odd_rows(spark, odd, none, library):
    coded = bpe_decode(bpe_encode(odd, RANKS), RANKS)
    assert set(odd.columns) | {"token_offsets", "decoded"} == set(coded.columns)
    rows = coded.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe_encode(none, RANKS).count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        bpe_decode(spark.createDataFrame([([99999],)], "ids array<int>"), RANKS).collect()
    assert bytes(bpe_decode(spark.createDataFrame([(None,)], "ids array<int>"), RANKS).first().decoded) == b""


def test_token_files(spark, odd, none, tmp_path):
    own = Tokenizer.from_file(TOKENIZER)
    path = str(tmp_path / "t")
    write_tokens(odd, path, TOKENIZER, end_id=2, files=3)
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = {i: own.encode(t or "", add_special_tokens=False).ids + [2] for i, t in [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]}
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd.select("doc_id").collect()), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids) == (start, len(want[r.doc_id]), want[r.doc_id])
        start += r.n_tokens
    crc = {r.doc_id: r.ids_crc32 for r in ids_crc32(read_tokens(spark, path), ["doc_id"]).collect()}
    assert all(crc[i] == zlib.crc32(np.array(w, "<u4").tobytes()) for i, w in want.items())
    write_tokens(none, str(tmp_path / "n"), TOKENIZER, files=2)
    assert read_tokens(spark, str(tmp_path / "n")).count() == 0


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, own):
        self.own, self.texts = own, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.own.encode_batch_fast(texts, **options)


def test_pieces_of_all_kinds_are_encoded_many_in_a_text():
    code, own = LibraryEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    counted = {k: Counted(v) for k, v in vars(code).items() if isinstance(v, Tokenizer)}
    vars(code).update(counted)
    words = [f"{a}{b}{c}" for a in ("", " ") for b in ("ab", "é", "漢", "🙂", "!", "\u0085") for c in map(chr, range(0x4E00, 0x4E64))]
    texts = [*words, *map(str, range(1000, 2000)), *("\n" * k + "x" for k in range(2, 40)), *("~" * k for k in range(1, 40))]
    ids, per = code.encode(texts)
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert per.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]
    assert sum(c.texts for c in counted.values()) <= 20  # about 2,500 distinct pieces


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_library_encoder_equals_the_library(texts):
    ids, per = encoder(TOKENIZER).encode(texts)
    want = [OWN.encode(t, add_special_tokens=False).ids for t in texts]
    assert per.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_vocabulary_without_some_bytes(tmp_path):
    own = Tokenizer(BPE({"a": 0, "b": 1, "Ġ": 2, "ab": 3, "Ġab": 4}, [("a", "b"), ("Ġ", "ab")]))
    own.pre_tokenizer = ByteLevel(add_prefix_space=False)
    own.save(str(tmp_path / "few.json"))
    texts = ["ab c a", "", "ccc", "ab ab\xff b", "\n"]
    ids, per = LibraryEncoder(str(tmp_path / "few.json")).encode(texts)
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert per.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_token_file_format(spark, odd, tmp_path):
    path = str(tmp_path / "t")
    write_tokens(odd, path, TOKENIZER, files=1)
    meta = pq.ParquetFile(next((tmp_path / "t").glob("part-*"))).metadata.row_group(0)
    by = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    ids = next(c for n, c in by.items() if n.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in by["doc_id"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in by.values())
    plan = read_tokens(spark, path, ids=False).where("doc_id = 4")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ids" not in plan.split("ReadSchema")[-1]


@pytest.fixture(scope="module")
def pieces():
    return PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


PART = st.sampled_from(["a", "the", "ing", "  ", " ", "é", "ß", "漢", "🙂", "\n", "\x00", "▁", "ﬁ", "1", "<s>", "<unk>", "<0x0A>", "==", "    ", "tion", "​"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PART, max_size=12).map("".join))
def test_every_prefix_count_is_exact(text):
    model, library = test_every_prefix_count_is_exact.models
    counts, per = model.encode([text, "x"])
    assert per.tolist() == [len(text) + 1, 2]
    assert counts[: per[0]].tolist() == [len(library.encode(text[:k])) for k in range(len(text) + 1)]


test_every_prefix_count_is_exact.models = (PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_totals_are_last_counts(texts):
    model, library = test_every_prefix_count_is_exact.models
    assert model.totals(texts).tolist() == [len(library.encode(t)) for t in texts]


def test_cache_generations_and_collisions(monkeypatch):
    """Words that are evicted, asked for again, or share a hash keep their own lists."""
    made = []

    def make(words):
        made.extend(words)
        lengths = np.array([len(w) for w in words])
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32), lengths

    cache, rng = ListCache(make, 20), random.Random(5)
    for step in range(60):
        words = list(dict.fromkeys("w" * rng.randint(1, 3) + str(rng.randint(0, 30)) for _ in range(12)))
        text = " ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = ends - [len(w) for w in words]
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        hashes = np.array([hash(w) % (7 if step % 2 else 1 << 60) for w in words], np.int64)
        values, start, length = cache.take(text, cps, starts, ends, hashes)
        assert ["".join(map(chr, values[a : a + n])) for a, n in zip(start, length)] == words
    assert len(made) < 60 * 12


def test_list_cache_finds_wide_pieces_again():
    made = []

    def make(new):
        made.extend(new)
        return np.array([ord(w[0]) for w in new], np.int32), np.ones(len(new), np.int64)

    cache, words = ListCache(make, 20), ["漢", "\uf642", "🙂", "ab"]  # the third is the second in its lower 16 bits
    for some in (words[:2], words, words):
        cps = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) for w in some])
        values, start, _ = cache.take("".join(some), cps, ends - [len(w) for w in some], ends, np.array([7 + len(w) for w in some]))
        assert values[start].tolist() == [ord(w[0]) for w in some]
    hashes = np.array([100, 101, 102, 103])
    made.clear()
    for _ in range(3):
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) for w in words])
        cache.take("".join(words), cps, ends - [len(w) for w in words], ends, hashes)
    assert made == words


def test_key_table():
    rng = np.random.default_rng(2)
    table, keys = KeyTable(8), rng.choice(1 << 40, 3000, replace=False)
    for part in np.split(keys, 10):
        table.put(part, (part % 1000).astype(np.int32))
    assert (table.get(keys) == keys % 1000).all() and (table.get(keys + (1 << 41)) == -1).all() and len(table.get(keys[:0])) == 0


def test_runs_of_blanks(pieces):
    model, library = pieces
    for n in (1, 7, 16, 17, 33, 70):
        text = "a" + " " * n + "b"
        assert model.encode([text])[0].tolist() == [len(library.encode(text[:k])) for k in range(len(text) + 1)]


def test_counts_on_odd_rows(odd, none, pieces):
    _, library = pieces
    counted = prefix_token_counts(odd, PIECES)
    rows = counted.withColumn("n", total_tokens("prefix_tokens")).withColumn("cut", longest_prefix("prefix_tokens", 3)).collect()
    totals = {(r.doc_id, r.text): r.n_tokens for r in token_totals(odd, PIECES).collect()}
    for r in rows:
        text = r.text or ""
        assert r.n == len(library.encode(text)) and len(r.prefix_tokens) == len(text) + 1
        assert totals[r.doc_id, r.text] == r.n
        if len(text) < 100:
            assert r.cut == max(k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= 3)
    assert prefix_token_counts(none, PIECES).count() == 0
    assert counted.where(F.col("doc_id") == 6).count() == 1
