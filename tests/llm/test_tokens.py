"""Encoders, counts, token files and packing against the tokenizers library and plain definitions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from boutline.llm import bpe, packing, tokenfile, units, wordpiece
from boutline.llm.bytesops import text_bytes

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
HARD = ["", " ", None, "a  b", " a", "a ", "a \n b", "x\ty z", "it's <|endoftext|> ok<|endoftext|>  b", "é́ á   b", "\n\n a", "a\x1cb \x1c c", "İ ΣΑΣ x",
        "a  b   c \u0085d　 e", "don't, won't' 's x's a'sb Q'S", "Á İ Ka x1y2,3", "<|ENDOFTEXT|> <|x", "日本語 12٣ ½", "😀😀 ok", "ab" * 400,
        "x" * 1000 + " " + "é" * 300]


def check_units(coder, path, texts):
    library = Tokenizer.from_file(path)
    flat, bounds = coder.ids(*text_bytes(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        assert flat[bounds[k]:bounds[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("path,lead", [(BYTES, True), (WORDS, False)])
def test_units_equal_whole_texts(path, lead, given):
    check_units(units.library(path, lead), path, HARD + list(given.values()))


def test_rank_arrays_equal_the_library(given):
    check_units(bpe.coder(BYTES)[1], BYTES, HARD + list(given.values()))


@settings(max_examples=60, deadline=None)
@cases(st.lists(st.text(st.sampled_from("ab e'.,!\n\t1Zé <|>ß́"), max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    check_units(bpe.coder(BYTES)[1], BYTES, texts)
    check_units(units.library(WORDS, False), WORDS, texts)


def test_units_forget_and_learn_again(given, monkeypatch):
    monkeypatch.setattr(units, "MOST_UNITS", 50)
    coder = units.library(BYTES, True)
    for t in list(given.values())[:20]:
        check_units(coder, BYTES, [t])


def test_round_trip(odd, real, none):
    library = Tokenizer.from_file(BYTES)
    for df in (real, odd):
        texts = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in df.collect())
        got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, BYTES).collect() if r.doc_id is not None)
        want = []
        for gone, i, t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            said = library.decode(ids, skip_special_tokens=False)
            want.append((gone, i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
        assert got == sorted(w for w in want if not w[0])
    assert bpe.round_trip(none, BYTES).count() == 0
    assert {r.doc_id: len(r.ids) for r in bpe.encode_documents(odd.filter("doc_id < 5"), BYTES).collect()}[1] == 0


def test_long_word_equals_short(monkeypatch):
    coder = bpe.RankBpe(BYTES)
    text = [b"internationalisation" * 9, b"aaaaaaaaaa" * 30]
    long = coder.words(text)
    monkeypatch.setattr(bpe, "SHORT", 1000)
    assert coder.words(text) == long


def test_token_counts(odd, real, none):
    vocab = set(wordpiece.vocabulary(WORDS))
    longest = max(map(len, vocab))
    for df in (real.limit(60), odd.filter("doc_id <> 9 or doc_id is null")):
        got = wordpiece.token_counts(df, WORDS).collect()
        texts = df.collect()
        assert len(got) == len(texts)
        for g, r in zip(got, texts):
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            assert (g.doc_id, g.n_words, g.n_tokens) == (r.doc_id, len(words), sum(wordpiece.greedy_count(vocab, w.encode(), longest) for w in words))
    assert wordpiece.token_counts(none, WORDS).count() == 0


@settings(max_examples=80, deadline=None)
@cases(st.sets(st.text(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=12), st.sets(st.text(st.sampled_from("abcd"), min_size=1, max_size=9), min_size=1, max_size=8))
def test_automaton_on_small_vocabularies(tokens, texts):
    vocab = [tuple(t.encode()) for t in tokens] + [(*t.encode(), wordpiece.END) for t in list(tokens)[::2]]
    raw, bounds = text_bytes(pa.array(sorted(texts)))
    got = wordpiece.Automaton(vocab).count(raw, bounds[:-1], bounds[1:])
    assert got.tolist() == [wordpiece.greedy_count(set(vocab), t.encode(), 6) for t in sorted(texts)]


@pytest.mark.parametrize("wide", [False, True])
def test_token_files(spark, odd, real, none, wide):
    library = Tokenizer.from_file(BYTES)
    for df in (real, odd):
        folder = tokenfile.write_tokens(df.repartition(3), BYTES, 2, wide=wide)
        got = tokenfile.read_tokens(spark, folder, wide, with_ids=True).orderBy("start").collect()
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        start = 0
        for g, r in zip(got, rows, strict=True):
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32, g.ids) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
            start += len(ids)
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(none, BYTES, 2)).count() == 0


def check_packing(df, placed, length):
    library = Tokenizer.from_file(WORDS)
    texts = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())
    docs = [[*library.encode(t, add_special_tokens=False).ids, 2] for _, _, t in texts]
    assert sum(p.length for p in placed) == sum(map(len, docs))
    crcs = sorted((len(d), a, min(length, len(d) - a), zlib.crc32(np.array(d[a:a + length], "<u4").tobytes())) for d in docs for a in range(0, len(d), length))
    assert crcs == sorted((p.doc_tokens, p.start, p.length, p.ids_crc32) for p in placed)
    by = {}
    for p in placed:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(by) == list(range(len(by)))
    total = 0
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
        total += at if at & (at - 1) == 0 else length
    return 1 - sum(p.length for p in placed) / total


def test_packing(spark, odd, real, none):
    placed = packing.pack(real, WORDS).collect()
    assert check_packing(real, placed, 4096) < 0.03
    assert {p.doc_id for p in placed} == {r.doc_id for r in real.collect()}
    check_packing(odd, packing.pack(odd, WORDS, length=512, grain=8).collect(), 512)
    assert packing.pack(none, WORDS).count() == 0


def test_sequences(real):
    few = real.limit(40)
    placed = packing.pack(few, WORDS, length=256)
    rows = packing.sequences(few, placed, WORDS, length=256, pad_id=7).collect()
    assert {len(r.ids) for r in rows} <= {2**k for k in range(9)}
    library = Tokenizer.from_file(WORDS)
    first = placed.filter("offset = 0").first()
    ids = [*library.encode(few.filter(few.doc_id == first.doc_id).first().text, add_special_tokens=False).ids, 2][first.start:first.start + first.length]
    assert {r.sequence_id: r.ids for r in rows}[first.sequence_id][:first.length] == ids


def test_patterns_are_near_the_bound():
    rng = np.random.default_rng(3)
    sizes, counts = np.unique(rng.integers(1, 65, 5000), return_counts=True)
    used = packing.patterns(sizes, counts, 64)
    assert (sum(c * t for c, t in used) == counts).all()
    assert all((c * sizes).sum() <= 64 for c, _ in used)
    assert sum(t for _, t in used) <= 1.01 * (sizes @ counts) / 64 + len(sizes) / 8


def test_vocabularies_that_cut_otherwise(spark, odd, tmp_path):
    """A special token that opens otherwise, or a pre-tokenizer of another kind: texts are encoded whole, ids as the library's."""
    from tokenizers import pre_tokenizers

    from boutline.llm import units

    texts = [r.text or "" for r in odd.collect() if len(r.text or "") < 9000] + ["a <s> b<s>", " x [SEP]y  z"]
    for k, change in enumerate((lambda t: t.add_special_tokens(["<s>", "[SEP]"]), lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)))):
        tok = Tokenizer.from_file(BYTES)
        change(tok)
        path = str(tmp_path / f"{k}.json")
        tok.save(path)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        rows = tokenfile.read_tokens(spark, tokenfile.write_tokens(docs, path, 2), with_ids=True).orderBy("doc_id").collect()
        assert [list(r.ids) for r in rows] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    for path, lead in ((BYTES, True), (WORDS, False)):
        assert isinstance(units.library(path, lead), units.Units)


def test_width_of_ids(spark, tmp_path):
    """A vocabulary beyond 65,536 ids takes 32 bits an id; the files say so; the smallest doc_id is no null."""
    tok = Tokenizer.from_file(BYTES)
    tok.add_tokens([f"<|more{i}|>" for i in range(16_000)])
    path = str(tmp_path / "wide.json")
    tok.save(path)
    docs = spark.createDataFrame([(-(2**63), "a<|more15999|>"), (None, "b"), (2**63 - 1, "")], "doc_id bigint, text string")
    folder = tokenfile.write_tokens(docs, path, 2)
    rows = {r.doc_id: list(r.ids) for r in tokenfile.read_tokens(spark, folder, with_ids=True).collect()}
    assert rows == {d: tok.encode(t, add_special_tokens=False).ids + [2] for d, t in ((-(2**63), "a<|more15999|>"), (None, "b"), (2**63 - 1, ""))}
    assert max(rows[-(2**63)]) > 1 << 16
    with pytest.raises(ValueError):
        tokenfile.write_tokens(docs, path, 2, wide=False)
    with pytest.raises(ValueError):
        tokenfile.read_tokens(spark, folder, wide=False)
