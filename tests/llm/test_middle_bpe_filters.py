"""Fill-in-the-middle, exact encoding and the filter audit, against plain recomputation and the library's own encoder."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polyweft.llm import bpe, filters, fim, wordids
from polyweft.llm.queries import OP11_SQL, OP13_SQL, QUERIES, tokenizer_path

ROWS = [
    (1, "one two three four five six", "a"), (2, "one two three four five six", "b"), (3, None, None), (4, "", ""), (5, "one two three four five six", "a"), (5, "one two three four five six", "a"),
    (None, "one two three four five six", "b"), (None, "", None), (7, "lorem ipsum dolor sit amet " * 40_000, "b"), (8, "ÄÖÜ ß 日本 👩‍👩‍👧 <P> x", None), (9, " \n\x1c\x85\t", "c"),
    (10, "SHOUT & shout " * 30, "c"), (11, "SHOUT & shout " * 30, "c"), (0, "x" * 200_000, "a"),
]
SCHEMA = "doc_id long, text string, source string"
NAMES = ("n", "mask", "chars", "blocks", "part", "least", "texts", "head", "ids", "form", "fim", "o", "good")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("own") for c in NAMES})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def against(sql, out, tables):
    con = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas()  # noqa: F841
        con.execute(f"create table {name} as select * from frame")
    columns = sorted(out.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    assert Counter(map(tuple, out.select(*columns).collect())) == Counter(want.select(", ".join(columns)).fetchall())


# ---- fill-in-the-middle


def plain_middle(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(text)


def test_op11(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_fim"](spark, sf).collect()}
    assert got == {i: plain_middle(i, t) for i, t in texts.items()}
    assert {r[1] for r in got.values()} == {"plain", "psm", "spm"}
    against(OP11_SQL, QUERIES["op11_fim"](spark, sf), {"documents": spark.read.parquet(f"{sf}/documents.parquet")})


def test_middle_of_odd_rows(docs, clashing):
    out = fim.fill_in_middle(clashing)
    assert out.columns == clashing.columns  # its own column of that name is replaced
    got = out.withColumn("back", fim.restored_text(F.col("fim.form"), F.col("fim.output"))).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = r.text or ""
        assert tuple(r.fim)[:4] + tuple(r.fim)[5:] == plain_middle(r.doc_id, text)
        assert sha(r.fim.output) == r.fim.output_sha256 and r.back == text and r.n == "own"
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_middle_with_marks_at_the_cut():
    """A text may end or begin with parts of marks."""
    recipe = fim.Recipe(plain_percent=0)
    unit = fim.regex.compile(recipe.unit)
    rng = random.Random(5)
    seen = set()
    for i in range(4000):
        text = "".join(rng.choice(("<", ">", "P", "S", "M", "<S", "M>")) for _ in range(rng.randrange(9)))
        n, form, *_, output = fim.cut(recipe, unit, str(i), text)
        assert fim.restored(recipe, form, output) == text
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P<", "<S>", "<M>")])
def test_ambiguous_marks_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Recipe(prefix=marks[0], suffix=marks[1], middle=marks[2])


# ---- exact encoding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))


def plain_ids(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def test_op12(spark, sf, library):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, back = plain_ids(library, r.text or "")
        want[r.doc_id] = len(ids) // 4, hashlib.sha256(ids).hexdigest(), sha(back)
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_bpe"](spark, sf).collect()} == want


def test_encoding_of_odd_rows(docs, clashing, library):
    path = tokenizer_path(bpe.VOCABULARY)
    out = bpe.decoded(bpe.encoded(clashing, path, into="numbers"), path, "numbers")
    got = out.collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (bytes(r.numbers), r.decoded) == plain_ids(library, r.text or "") and r.ids == "own"
    assert bpe.encoded(docs.limit(0), path).count() == 0
    none = bpe.decoded(docs.limit(1).select(F.lit(None).cast("binary").alias("ids")), path).first()
    assert none.decoded == ""


PARTS = [*"abehinst019!'", "the", "and", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "É", "é", "J̌", "ẖ", "ß", "日本", "́", "İ", "Σ", "ς", "\xa0", "\x1c", "\x85", "　", "‍", "😀", " ", "\n", "\t", "\0", "Ⅷ", "٣", "ǅ", "</w>"]


def test_encoding_equals_the_library(library):
    encoder, decoder = bpe.Encoder(tokenizer_path(bpe.VOCABULARY)), bpe.Decoder(tokenizer_path(bpe.VOCABULARY))
    encoder.MOST_PIECES = encoder.MOST_PAIRS = 50  # tables are emptied again and again
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(24))) for _ in range(8000)]
    texts += ["".join(rng.choice("aabetshinor") for _ in range(rng.randrange(200, 2000))) for _ in range(60)]  # long words, much given up
    for t in texts:
        ids = encoder.text(t.encode())
        assert (ids, decoder.text(ids).decode()) == plain_ids(library, t), repr(t)


def test_the_table_of_words_equals_the_library(library):
    """Marks that compose with a small letter alone (J and a caron) are why lower case comes after normalising."""
    words = wordids.WordIds(tokenizer_path(bpe.VOCABULARY))
    rng = random.Random(9)
    texts = ["J̌ ẖ", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(24))) for _ in range(4000))]
    for t, ids in zip(texts, words.texts(t.encode() for t in texts)):
        assert ids == plain_ids(library, t)[0], repr(t)


def test_compatible_pairs_are_what_merges_leave(library):
    """The table of pairs against merges that are run one by one."""
    encoder = bpe.Encoder(tokenizer_path(bpe.VOCABULARY))

    def merged(tokens):
        tokens = list(tokens)
        while True:
            found = [(encoder.merge[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in encoder.merge]
            if not found:
                return tokens
            made, i = min(found)
            tokens[i : i + 2] = [made]

    def basic(token):
        return [token] if token < encoder.basic else basic(encoder.left[token]) + basic(encoder.right[token])

    rng = random.Random(3)
    fits = 0
    for _ in range(20_000):
        a, b = (rng.choice((rng.randrange(60), rng.randrange(512, 1500), rng.randrange(len(encoder.length)))) for _ in "ab")
        want = merged(basic(a) + basic(b)) == [a, b]
        assert encoder.compatible(a, b) == want
        fits += want
    assert 1000 < fits < 19_900


def test_ids_that_are_no_token_are_left_out(library):
    decoder = bpe.Decoder(tokenizer_path(bpe.VOCABULARY))
    assert decoder.text(np.array([320, 10**9, 320], "<u4").tobytes()) == decoder.text(np.array([320, 320], "<u4").tobytes())


# ---- filter audit


def plain_audit(rows, labels):
    texts = [(i, t or "", s or "") for i, t, s in rows]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    told = []
    for i, t, part in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, bad in zip("ABCDE", (len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > least[t])) if bad}
        told.append((part, fails, (1, None) in labels.get(i, ()) or any(q == 1 for q, _ in labels.get(i, ())), any(x == 1 for _, x in labels.get(i, ()))))
    out = []
    for part in {t[0] for t in told}:
        own = [t for t in told if t[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [t for t in left if f in t[1]]
                left = [t for t in left if f not in t[1]]
                shapley[f] += len(removed)
                out.append([part, order, step, len(left), len(removed), sum(f in t[1] for t in own) - len(removed), sum(t[1] == {f} for t in own), sum(t[2] for t in removed), sum(t[3] for t in removed), f])
    return Counter((*r[:9], shapley[r[9]]) for r in out for shapley in [_shapley(out, r[0])])


def _shapley(out, part, known={}):
    if (id(out), part) not in known:
        known[id(out), part] = Counter()
        for r in out:
            if r[0] == part:
                known[id(out), part][r[9]] += r[4]
    return known[id(out), part]


LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (10, 0, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1), (5, None, None)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def as_dict(rows):
    out = {}
    for i, q, t in rows:
        if i is not None:
            out.setdefault(i, []).append((q, t))
    return out


def test_op13(spark, sf):
    against(OP13_SQL, QUERIES["op13_filters"](spark, sf), {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")})


@pytest.mark.parametrize("most_sent", [None, 1])
def test_audit_of_odd_rows(docs, clashing, labels, monkeypatch, most_sent):
    if most_sent:  # groups beyond what is broadcast: hot ones apart, the rest by a shuffle
        monkeypatch.setattr(filters, "MOST_SENT", most_sent)
    want = plain_audit(ROWS, as_dict(LABELS))
    assert Counter(map(tuple, filters.audited(docs, labels).collect())) == want
    assert Counter(map(tuple, filters.audited(clashing.withColumn("filter_order", F.lit(1)), labels.withColumn("n", F.lit(7))).collect())) == want
    assert filters.audited(docs.limit(0), labels).count() == 0
    assert Counter(map(tuple, filters.audited(docs, labels.limit(0)).collect())) == plain_audit(ROWS, {})


def test_texts_that_share_all_hashes(spark, docs, labels, monkeypatch):
    """A hash that tells nothing apart: the full texts still do."""
    monkeypatch.setattr(filters, "block_hashes", lambda text: F.array(F.lit(1).cast("bigint")))
    more = ROWS + [(20, "one two three four five siy", "a"), (21, "one two three four five siy", "a"), (6, "one two three four five siz", "b")]
    assert Counter(map(tuple, filters.audited(spark.createDataFrame(more, SCHEMA), labels).collect())) == plain_audit(more, as_dict(LABELS))


def test_texts_that_differ_in_a_late_block(spark):
    long = "ab " * 5000
    rows = [(1, long + "x", "a"), (2, long + "y", "a"), (3, long + "x", "a"), (4, "c" + long, "a")]
    got = {r.doc_id: r.mask >> 4 for r in filters.marked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}
