"""The stemmer and the stored full-text index against plain code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fernloom.functions.stemming import STOP_WORDS, stem
from fernloom.operators.fulltext import build_index, headline

STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori
conspicuously conspicu conspiracy conspiraci knavish knavish kneaded knead knees knee knightly knight knitted knit knives knive generate generat generally general generous generous
community communiti skies sky news news happy happi cry cri by by say say hopping hop hoping hope hopefulness hope relational relat conditional condit rational ration digitizer digit
operator oper feudalism feudal decisiveness decis sensibilities sensibl triplicate triplic formative format electricity electr replacement replac adoption adopt rate rate controlling control
rolling roll succeeding succeed proceed proceed agreed agre feed feed ties tie cries cri gas gas this this kiwis kiwi fluently fluentli possibly possibl geology geolog youth youth enjoy enjoy""".split()


def test_stem():
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2], strict=True))


WEIGHTS = {"title": 1.0, "body": 0.4}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    vocab = ["connect", "connected", "connecting", "connection", "the", "of", "relation", "relational", "river", "rivers", "été", "x1", "abcdef", "abcdfe"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 5)), text(rng.randint(0, 40))) for i in range(120)]
    rows += [(200, None, None), (201, "", "river " * 3000 + "CONNECTIONS"), (202, "Rivers", None), (203, "river connect", "river connect"), (None, "river", "connected")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string").withColumn("word", F.lit("river"))
    return rows, docs, build_index(docs, str(tmp_path_factory.mktemp("index") / "i"), WEIGHTS, buckets=4)


def tokens(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def plain_rank(title, body, asked):
    words = [(w, 1.0) for w in tokens(title)] + [(w, 0.4) for w in tokens(body)]
    hits = [(i, stem(w), 1 / c) for i, (w, c) in enumerate(words) if stem(w) in asked]
    runs = [(a, b) for a in range(len(hits)) for b in range(a, min(len(hits), a + 200)) if {h[1] for h in hits[a : b + 1]} == set(asked)]
    least = [(a, b) for a, b in runs if not ((a + 1, b) in runs or (a, b - 1) in runs)] if len(hits) < 400 else []
    return sum((b - a + 1) / sum(h[2] for h in hits[a : b + 1]) / (1 + hits[b][0] - hits[a][0] - (b - a)) for a, b in least)


@pytest.mark.parametrize("query", ["connections", "River of CONNECTING", "river connect relation", "été", "river river"])
def test_ranked(corpus, query):
    rows, _, index = corpus
    asked = list(dict.fromkeys(stem(w) for w in tokens(query) if w not in STOP_WORDS))
    want = {i: round(s, 6) for i, t, b in rows if i != 201 and (s := plain_rank(t, b, asked))}
    got = {r["doc"]: r["score"] for r in index.ranked(query).collect()}
    assert got.pop(201, None) is not None or "relation" in query or "été" in query
    assert got == pytest.approx(want, abs=2e-6)
    assert got


def test_finds_nothing(corpus):
    index = corpus[2]
    assert index.ranked("the of").collect() == index.ranked("").collect() == index.ranked("river absent").collect() == []


def test_reads_own_words_only(corpus):
    plan = corpus[2].of(["river", "rivers"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(word" in plan


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_and_fuzzy(corpus):
    rows, _, index = corpus
    terms = ["rivr", "abcdef", "conect", "of", "x"]

    most = lambda t: 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2
    vocab = {w for _, t, b in rows for w in tokens(t) + tokens(b)}
    want = {(t, w, distance(t, w)) for t in terms for w in vocab if distance(t, w) <= most(t)}
    assert {tuple(r) for r in index.near(terms).collect()} == want and len(want) >= 5
    field = lambda text: sum(max((1 - d / len(t) for t2, w, d in want if t2 == t and w in tokens(text)), default=0) for t in terms)
    scores = {i: round(max(3 * field(t), field(b)), 6) for i, t, b in rows}
    got = {r["doc"]: r["score"] for r in index.fuzzy(terms, [3.0, 1.0]).collect()}
    assert got == pytest.approx({i: s for i, s in scores.items() if s}, abs=2e-6)


def test_headline(corpus):
    forms = [["river", "rivers"], ["connect"]]
    assert headline("A river, connect.", forms) == "A <mark>river</mark>, <mark>connect</mark>"
    assert headline("no hit " * 40, forms) == ("no hit " * 40)[:200]
    far = headline("river " + "x " * 80 + "connect", forms)
    assert far.count(" ") == 49 and far.startswith("<mark>river</mark> x")
    near = headline("river " + "x " * 80 + "connect rivers " + "y " * 5, forms)
    assert near.endswith("<mark>connect</mark> <mark>rivers</mark> y y y y y") and len(near.split()) == 20
    got = corpus[2].headlines("river connect", corpus[1], "doc_id", "body", 5).collect()
    assert len(got) == 5 and all(r["headline"] == headline(next(b for i, _, b in corpus[0] if i == r["doc"]) or "", corpus[2].forms("river connect")) for r in got)


def test_a_row_for_each_word_of_a_field(corpus):
    """Places of a word in a field are one row, sorted, and the first field of a document that has the word is marked."""
    _, _, index = corpus
    every = {}
    for r in index.occurrences().collect():
        every.setdefault((r["word"], r["doc"], r["field"]), []).append(r["pos"])
    rows = index.places().collect()
    assert {(r["word"], r["doc"], r["field"]): list(r["pos"]) for r in rows} == {k: sorted(v) for k, v in every.items()}
    assert len(rows) == len(every) < sum(map(len, every.values()))
    assert {(r["word"], r["doc"], r["field"]) for r in rows if r["first"]} == {(w, d, min(f for x, y, f in every if (x, y) == (w, d))) for w, d, _ in every}
