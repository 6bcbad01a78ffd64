"""Quality, language, near duplicates, secrets, shards and fingerprints against plain definitions."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boutline.llm import fingerprint, langid, near, queries, quality, secret_scan, secrets, shard
from boutline.llm.bytesops import text_bytes
from tests.check import compare, connect
from tests.llm.conftest import FOLDER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def repeats(words):
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)})


def test_quality_against_sql(spark):
    error, *_ = compare(connect(FOLDER), spark, "op1", queries.QUERIES["op1_quality_rules"], queries.ORACLES["op1_quality_rules"], FOLDER)
    assert error is None, error


def test_quality_measures(spark, odd, none):
    base = "one two three four five six seven eight nine"
    extra = spark.createDataFrame([(20, f"{base}\n{base}\n \n{base} tail"), (21, "a " * 40), (22, "# $ % < >\n#")], "doc_id bigint, text string")
    df = odd.select("doc_id", "text").unionByName(extra)
    for r, g in zip(df.collect(), quality.quality(df).collect(), strict=True):
        words = WORD.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), repeats(words))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert g.kept == (g.rejected_by is None) and not (g.base_failed and g.kept)
    assert quality.quality(none).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {5, 6, 9, None}
    assert quality.keep_good(none).count() == 0


def test_cascade_orders_by_rejection_per_cost(spark):
    sample = spark.range(2000).cache()
    slow = F.expr("aggregate(sequence(1, 3000), 0L, (a, x) -> a + x * id) < 0")
    assert quality.ordered(sample, {"never": F.col("id") < 0, "often": F.col("id") < 1500, "dear": slow})[0] == "often"
    assert quality.ordered(sample, {"dear": slow | (F.col("id") < 100), "often": F.col("id") < 1500}) == ["often", "dear"]


def test_quality_drops_junk_and_keeps_clean(spark, real):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.quality(real).join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98


def test_language(spark, odd, real, none):
    model = langid.fit(real, queries.remainder() != 2)
    got = {r.doc_id: r for r in langid.identify(real, model).collect()}
    held = [r for r in real.filter(queries.remainder() == 2).collect() if any(c.isalpha() for c in r.text)]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    for r in langid.identify(odd, model).collect():
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3) or (r.doc_id is None and r.score == 0))
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none, F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, empty).collect()} == {("und", 0.0)}
    assert langid.keep_known(odd, model, 0.25).columns == odd.columns
    assert 2 not in {r.doc_id for r in langid.keep_known(odd, empty, 0.25).collect()}


def test_more_languages_than_bits(spark):
    """Every one of 150 languages, each of words of its own, is told from the others."""
    rng = np.random.default_rng(3)
    words = [["".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for _ in range(6)] for _ in range(150)]
    rows = [(i * 4 + k, " ".join(rng.permutation(words[i] * 3)), f"l{i}") for i in range(150) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model.tables.shape[0] == 3
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert got == {i: name for i, _, name in rows}
    assert langid.keep_known(docs, model, 0.25).count() == len(rows)


@pytest.mark.parametrize("text,want", [(None, False), ("", False), ("12 ½ ² _!", False), ("½a", True), ("日", True)])
def test_letters(text, want):
    assert langid.lettered(text) == want


def test_language_masks_match_sets(real):
    """The filters answer for every n-gram put in, and seldom for others."""
    rng = np.random.default_rng(5)
    table = np.zeros(1 << langid.BITS, np.uint64)
    sets = [rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(3)]
    for i, s in enumerate(sets):
        for at in langid.slots(s):
            np.bitwise_or.at(table, at, np.uint64(1 << i))
    model = langid.Model(["a", "b", "c"], table)
    for i, s in enumerate(sets):
        found = np.full(len(s), 2**64 - 1, np.uint64)
        for at in langid.slots(s):
            found &= table[at]
        assert (found & np.uint64(1 << i)).all()
        assert abs(np.mean((found & np.uint64(1 << (i + 1) % 3)) > 0) - model.chance[(i + 1) % 3]) < 0.002


def sets_of(texts, width):
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        out.append(frozenset(zip(*[w[i:] for i in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def brute(ids, texts, width):
    sets, head = sets_of(texts, width), {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(ids[i]), find(ids[j])
                head[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def edits(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(6):
        base = [f"t{x}" for x in rng.integers(0, 400, 90)]
        texts += [edits(rng, base, int(k)) for k in rng.integers(0, 9, 14)] + [" ".join(base).upper()] * 2
    texts += ["of the"] * 3 + ["solo", "Solo", "", None, "  "]
    ids = rng.permutation(len(texts)).tolist()
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, width).collect()}
        assert got == brute(ids, texts, width)
    rows = near.near_duplicates(odd, 5).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {r.kept for r in rows if r.doc_id in (1, 2, 3, None)} == {True}
    assert near.near_duplicates(none).count() == 0
    kept = near.keep_first(odd, 5)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]


def test_large_near_group_is_searched_whole(spark, monkeypatch):
    """A group above every block size, at the edge of the threshold, must come out as brute force says."""
    for name, v in (("LEAF", 20), ("BLOCK", 16), ("EDGE_BLOCK", 10), ("LEVELS", 3)):
        monkeypatch.setattr(near, name, v)
    rng = np.random.default_rng(4)
    base = [f"b{x}" for x in range(80)]
    texts = [edits(rng, base, int(k)) for k in rng.integers(2, 7, 260)]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, 2).collect()}
    assert got == brute(ids, texts, 2)


@pytest.mark.parametrize("level", range(1, 7))
def test_near_pairs_meet_at_any_depth(level):
    """Pairs of similarity 0.8 whose groups branch ``level`` times in every tree: about 1e-4 of them may part in all trees they walk."""
    rng, n = np.random.default_rng(31), 20_000
    trees = near.TREES if level <= near.SHALLOW else near.TREES + near.DEEP_TREES
    one = np.concatenate([rng.integers(0, 2**32, (n, near.MINS)), rng.integers(0, 256, (n, near.MORE))], axis=1)
    two = np.where(rng.random(one.shape) < 0.8, one, one + 1)
    met = np.zeros(n, bool)
    for tree in range(trees):
        keys = []
        for tokens in (one, two):
            at, which, path = near.entered(n, range(tree, tree + 1))
            for k in range(1, level + 1):
                at, which, path = near.branch(tokens, at, which, path, k)
            keys.append(np.unique(np.stack([at.astype(np.uint64), path]), axis=1))
        both, k = np.unique(np.concatenate(keys, axis=1), axis=1, return_counts=True)
        met[both[0, k > 1].astype(np.int64)] = True
    assert np.count_nonzero(~met) <= 6, np.count_nonzero(~met)


def test_near_coordinates_have_one_use():
    used = [int(near.coordinate(np.array([t]), level, o)[0]) for t in range(near.TREES + near.DEEP_TREES) for level in range(1, near.LEVELS + 1) for o in (0, 1)]
    assert len(set(used)) == len(used) and max(used) < near.MINS + near.MORE


def test_near_pairs_in_deep_groups(spark, monkeypatch):
    """Texts that share most of their frequent shingles branch six times; pairs at the edge of the threshold are still found."""
    monkeypatch.setattr(near, "LEAF", 2)
    rng = np.random.default_rng(12)
    common = [f"c{x}" for x in range(70)]
    texts = []
    for i in range(60):
        base = common + [f"own{i}x{x}" for x in range(50)]
        texts += [" ".join(base), edits(rng, base, 6)]
    deep, walked = [], near.walked
    monkeypatch.setattr(near, "walked", lambda nodes, trees: deep.append(trees) or walked(nodes, trees))
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, 2).collect()}
    assert got == brute(ids, texts, 2)
    assert deep == [range(near.TREES), range(near.TREES, near.TREES + near.DEEP_TREES)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 103), (200, 200)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}}


# Fixed values of the contract, written out anew so that the scanner is not tested against itself.
PLAIN = {"assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            n = len(m[1]) if kind == "assign" else len(m[0])
            if n >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", ["", "token: token=abcdef1", "secret: token : abcdefg", "PASSWORD='x' api-key=1", "Api_Key = zzzzzz apikey:'yyyyyyy'", "AKIA" + "B" * 16 + " AKIAAKIA", "f" * 24 + "g" + "0" * 23,
                                  "ſecret=abcdefgh", "password=" + "a1" * 500, "é token=ééabcdef", "token=abcdef" * 20, "secret = secret = abcdefg"])
def test_base_spans(text):
    assert secrets.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text,want", [
    ('client_secret = "aB3$kdkd83jdK2"', {"aB3$kdkd83jdK2"}), ('k = "ZX81abcDEF993kQ"\nconn = k\ndb_passphrase: conn', {"ZX81abcDEF993kQ"}),
    ('passphrase = "correct1" + "Horse9!"', {"correct1", "Horse9!"}), ("<pwd>hunter2!A9</pwd>", {"hunter2!A9"}), ('public_key = "aaaBBB111"', set()),
    ("count: 12345678 size = 'aB3$kdkd83jdK2'", set()), ('pwd = "changeme"', set()), ('private_key => \'x9Kq2LmZ77\'', {"x9Kq2LmZ77"}), ('pwd = ""', set())])
def test_assigned_literals(text, want):
    assert {text[s:e] for s, e in secrets.literals(text)} == want


@pytest.mark.parametrize("text,want", [
    ('signing_key = "' + "aB3$" * 1250 + '"', {"aB3$" * 1250}), ("signing_key = " + "aB3" * 2000, {"aB3" * 2000}),
    ('client_secret: str = "aB3$kdkd83jdK2"', {"aB3$kdkd83jdK2"}), ("const clientSecret: string = 'aB3$kdkd83jdK2';", {"aB3$kdkd83jdK2"}),
    ('client_secret: Optional[str] = "aB3$kdkd83jdK2"', {"aB3$kdkd83jdK2"}), ("const CLIENT_SECRET: &'static str = \"aB3$kdkd83jdK2\";", {"aB3$kdkd83jdK2"}),
    ('client_secret = "ab1X9" + "Zq77k"', {"ab1X9", "Zq77k"}), ("run --client-secret=aB3kdkd83jdK2 -v", {"aB3kdkd83jdK2"}),
    ('cmd = "run --client-secret=aB3kdkd83jdK2"', {"aB3kdkd83jdK2"}), ('client_secret = k\nk = j\nj = "ZX81abcDEF993kQ"', {"ZX81abcDEF993kQ"}),
    ('private_key = """aB3$kd\nkd83jdK2"""', {"aB3$kd\nkd83jdK2"}), ("private_key = `aB3$kd\nkd83jdK2`", {"aB3$kd\nkd83jdK2"}),
    ('private_key="aB3$kd\nkd83jdK2"', {"aB3$kd\nkd83jdK2"})])
def test_whole_literals(text, want):
    assert {text[s:e] for s, e in secrets.literals(text)} == want


KEY = "aB3$kdkd83jdK2"


@pytest.mark.parametrize("text,want", [
    (f'client_secret\t=\t"{KEY}"', {KEY}), (f'client_secret =\n    "{KEY}"', {KEY}), (f'client_secret = \\\n  "{KEY}"', {KEY}), (f'client_secret = f"{KEY}"', {KEY}),
    (f'client_secret = b"{KEY}"', {KEY}), (f"client_secret = r'{KEY}'", {KEY}), (f'client_secret = rb"{KEY}"', {KEY}), ('client_secret = ("aB3$kd" "kd83jdK2")', {"aB3$kd", "kd83jdK2"}),
    ('client_secret = (\n  "aB3$kd"\n  "kd83jdK2"\n)', {"aB3$kd", "kd83jdK2"}), (f'credentials = {{"x": "{KEY}"}}', {KEY}), (f'credentials = {{"x": {{"y": ["a", "{KEY}"]}}, "z": 1}}', {KEY}),
    (f'<add key="ClientSecret" value="{KEY}"/>', {KEY}), (f'<add value="{KEY}" name="ClientSecret"/>', {KEY}), (f'define("DB_PASSPHRASE", "{KEY}");', {KEY}),
    (f'os.setenv("CLIENT_SECRET", "{KEY}")', {KEY}), (f'client_secret = os.environ.get("X", "{KEY}")', {KEY}), ('client_secret = os.environ.get("CLIENT_NAME")', set()),
    (f"client_secret: |\n  {KEY}\nother: x", {KEY}), ("spec:\n  private_key: |-\n    aB3kd83jdK2\n    Zq77kLm0Pa\n  size: 4", {"aB3kd83jdK2", "Zq77kLm0Pa"}),
    ('names = {"x": "aB3$kdkd83jdK2"}', set()), ('credentials = {"kind": "service", "region": "north"}', set()), (f'credentials = {{"x": "{KEY}"', set()), ('define("TITLE", "aB3$kdkd83jdK2")', set()),
    ("client_secret = load_secret(name)", set()), ('tokens = tokenize("some longer words here")', set())])
def test_literals_of_common_syntax(text, want):
    assert {text[s:e] for s, e in secrets.literals(text)} == want


@pytest.mark.parametrize("text", ["secret = {" * 20_000, "secret = [" * 9_000 + "'aB3$kdkd83jdK2'" + "]" * 9_000, "secret: |\n " * 20_000, 'define("secret", ' * 15_000, "secret =\n" * 20_000, 'secret = ("a" ' + '"b" ' * 50_000, "secret\t" * 30_000, 'key="secret" ' * 15_000, "new " * 40_000])
def test_lexer_takes_linear_time_on_brackets(text):
    began = time.process_time()
    secrets.literals(text)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("text", ["token: " * 30_000, "a: b " * 30_000, 'k = "' * 30_000, "-" * 200_000, ("pwd = " + 3 * "\x27") * 9_999, "a: " + "b " * 90_000, "a: b<" * 30_000, "x: [" * 30_000])
def test_lexer_takes_linear_time(text):
    began = time.process_time()
    secrets.literals(text)
    assert time.process_time() - began < 5


def test_secret_spans(odd, real, none):
    for df in (odd, real):
        for r, g in zip(df.collect(), secret_scan.secret_spans(df).collect(), strict=True):
            base = plain_spans(r.text or "")
            told = ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in base)
            assert [g.n_assign, g.n_access, g.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
            assert g.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
            assert set(told.split(",")) - {""} <= set(g.spans.split(","))
    assert secret_scan.secret_spans(none).count() == 0
    masked = secret_scan.mask_secrets(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    row = masked.filter("doc_id = 7").first()
    assert row.text == "[SECRET]'" and row.n_chars == 9
    assert masked.filter("doc_id = 5").first().text == odd.filter("doc_id = 5").first().text


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096, 4097])
def test_permutation(n):
    p = shard.permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n))
    assert shard.unpermute(p, n, 5).tolist() == list(range(n))
    assert n < 100 or (p != shard.permute(np.arange(n), n, 6)).mean() > 0.9


def test_shards(odd, real, none):
    for df in (real, odd):
        rows = shard.feistel_shards(df.repartition(5), 16).collect()
        texts = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert texts == sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by[k]) for k in range(16)]
        assert max(sizes) - min(sizes) <= 1
    order = sorted((r for r in shard.feistel_shards(real, 16).collect()), key=lambda r: r.doc_id)
    assert [(r.shard, r.slot) for r in order] == [(int(p) % 16, int(p) // 16) for p in shard.permute(np.arange(len(order)), len(order), 1)]
    assert shard.feistel_shards(none, 16).count() == 0


def test_fingerprints(real, given):
    ids = sorted(given)
    got = {r.doc_id: r for r in fingerprint.compare_edits(real.repartition(4)).collect()}
    one = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(real).collect()}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        text = fingerprint.edited(given[i], given[ids[k - 1]])
        assert got[i].n_chars == len(given[i]) and got[i].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[i].fingerprint == one[i]
        assert got[i].edited_fingerprint == fingerprint.spelled(fingerprint.signatures(*text_bytes(pa.array([text]))))[0]
    long = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.6
    assert np.mean([r.near_next for r in long if r.fingerprint != one[ids[ids.index(r.doc_id) - 1]]]) < 0.1
    by_text = collections.defaultdict(set)
    for i, t in given.items():
        by_text[t].add(one[i])
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_do_not_depend_on_the_offset(given):
    text = max(given.values(), key=len)[:4000]
    shifted = ["", "x", "some words before "]
    marks = fingerprint.signatures(*text_bytes(pa.array([s + text for s in shifted])))
    assert (fingerprint.likeness(marks[:1].repeat(3, 0), marks) > 0.9).all()


def test_odd_fingerprints(odd, none):
    rows = fingerprint.compare_edits(odd).collect()
    assert len(rows) == odd.count()
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {fingerprint.EMPTY}
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert fingerprint.compare_edits(none).count() == 0
    alone = fingerprint.compare_edits(odd.filter("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
