"""Training-data operators against brute force, and on awkward input."""

import ast
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.llm import close, distinctive, doc_pairs, fusion, leakage, near_duplicates, neighbors, packing, plain, quality, splitting
from graphlake.llm.queries import ORACLE, QUERIES
from graphlake.sources.tables import latest_rows


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- plain form ---------------------------------------------------------------------------------------------------


def test_plain_form():
    assert plain.words("<b>Café</b>&nbsp;cam-\r\n  era so­lid x-1 ﬁn") == ["cafe", "camera", "solid", "x", "1", "fin"]
    assert plain.plain(None) == "" and plain.words("<" + "a" * 201 + ">") == ["a" * 201]


# --- 1 splitting --------------------------------------------------------------------------------------------------


def test_pieces_cover_and_overlap(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["wing", "spar", "rib.", "fin,", "keel\n\n"]) for _ in range(1500))
    cuts = splitting.cut_points(text, 360, 30, 120)
    assert cuts[0][0] == 0 and cuts[-1][1] == 1500
    for (a, b, x, y), (c, d, _, _) in zip(cuts, cuts[1:], strict=False):
        assert b - a <= 360 and b - c == 30 and d > b and len(text[x:y].split()) == b - a


def test_an_edit_changes_only_near_pieces():
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") + str(rng.randrange(500)) + rng.choice(["", "", "."]) for _ in range(6000)]
    before = {" ".join(words)[x:y] for _, _, x, y in splitting.cut_points(" ".join(words), 360, 30, 120)}
    words[300:300] = ["new", "words"]
    after = {" ".join(words)[x:y] for _, _, x, y in splitting.cut_points(" ".join(words), 360, 30, 120)}
    assert len(after - before) <= 8 and len(after) > 18


def test_cut_is_at_the_boundary_nearest_to_the_landmark():
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    rolled = splitting._rolling(words, 8)[119:360]
    marked = np.flatnonzero(rolled % 48 == 0)
    landmark = 119 + int(marked[0] if len(marked) else np.argmin(rolled))
    for near, far in ((2, 60), (-2, 60)):
        ends = sorted({landmark + near, landmark + far})
        text = " ".join(w + (".\n\n" if i == landmark + far else "." if i in ends else "," if i == landmark else "") for i, w in enumerate(words))
        rolled_again = splitting._rolling([w + ("." if i in ends else "," if i == landmark else "") for i, w in enumerate(words)], 8)[119:360]
        again = np.flatnonzero(rolled_again % 48 == 0)
        target = 119 + int(again[0] if len(again) else np.argmin(rolled_again))
        wanted = min(ends, key=lambda e: abs(e - target))
        assert splitting.cut_points(text, 360, 30, 120)[0][1] == wanted + 1


def test_split_awkward(spark):
    data = [("a", None, 1), ("b", "", 1), ("c", "w " * 400, 1), ("c", "w " * 400, 1), ("d", "x" * 100_000, 1), ("e", " ".join(["u"] * 361), 1)]
    df = spark.createDataFrame(data, "id string, text string, piece int")
    got = rows(splitting.split_oversized(df, "text"), "id", "n_pieces")
    assert Counter(got) == Counter({("a", 1): 1, ("b", 1): 1, ("c", 2): 4, ("d", 1): 1, ("e", 2): 2})
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_depth(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "gone")], "k string, up string")
    assert dict(rows(splitting.depth_by_parent(df, "k", "up"))) == {"a": 1, "b": 2, "c": 3, "d": 4, "x": None, "y": None, "z": 1}


# --- 2 neighbours -------------------------------------------------------------------------------------------------


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 64))
    vectors = np.concatenate([base, base[:150] + 0.15 * rng.standard_normal((150, 64)), np.repeat(base[:1], 40, 0)]).astype(np.float32)
    data = [(f"n{i:04d}", v.tolist()) for i, v in enumerate(vectors)]
    bad = [("null", None), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] + [1.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame(data + bad, "node_id string, dense array<float>").withColumn("id", F.lit("clash"))
    got = defaultdict(set)
    for r in neighbors.nearest_nodes(df, 5, 64, 0.8).collect():
        got[r["node_id"]].add(r["other"])
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 12)
    hit = total = 0
    for i in range(len(data)):
        best = sorted((j for j in range(len(data)) if j != i and cos[i, j] >= 0.8), key=lambda j: (-cos[i, j], j))[:5]
        total += len(best)
        hit += len({data[j][0] for j in best} & got[data[i][0]])
    assert total > 300 and hit / total >= 0.95
    assert not set(got) & {"null", "short", "zero", "nan"}
    assert neighbors.nearest_nodes(df.limit(0), 5, 64).count() == 0


@pytest.mark.parametrize(("near", "blocks", "visitors"), [(False, 16, 10**6), (True, 16, 10**6), (False, 4, 500), (True, 2, 500)])
def test_recall_across_cells_without_floor(spark, monkeypatch, near, blocks, visitors):
    monkeypatch.setattr(neighbors, "CELL", 100)
    monkeypatch.setattr(neighbors, "BLOCKS", blocks)
    monkeypatch.setattr(neighbors, "HELD", 1000)
    monkeypatch.setattr(neighbors, "VISITORS", visitors)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1600, 64))
    if near:  # clusters, whose neighbours are close
        vectors = np.repeat(vectors[:200], 8, 0) + 0.3 * vectors
    vectors = vectors.astype(np.float32)
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    wanted = {(i, int(j)) for i, line in enumerate(np.argsort(-cos, axis=1)[:, :5]) for j in line}
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(vectors)], "node_id string, dense array<float>").repartition(5)
    got = {(int(r["node_id"]), int(r["other"])) for r in neighbors.nearest_nodes(df, 5, 64).collect()}
    assert len(got) == 5 * 1600 and len(got & wanted) >= 0.95 * len(wanted)
    asked = spark.createDataFrame([(str(i),) for i in range(0, 1600, 20)] + [("gone",), (None,)], "node_id string")
    few = {(int(r["node_id"]), int(r["other"])) for r in neighbors.nearest_of(asked, df, 5, 64).collect()}
    some = {w for w in wanted if w[0] % 20 == 0}
    assert len(few) == 5 * 80 and len(few & some) >= 0.98 * len(some)
    assert neighbors.nearest_of(asked.limit(0), df).count() == 0 and neighbors.nearest_of(asked, df.limit(0)).count() == 0


@pytest.mark.parametrize("parted", [False, True])
def test_close_vectors_across_cells(spark, monkeypatch, parted):
    monkeypatch.setattr(close, "SMALL", 8)
    if parted:
        monkeypatch.setattr(close, "HELD", 100)
        monkeypatch.setattr(close, "VISITORS", 700)
        monkeypatch.setattr(close, "HOME", 300)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((1500, 64))
    spiked = 0.05 * rng.standard_normal((100, 64))
    spiked[np.arange(100), np.arange(100) % 64] = 3
    vectors = np.concatenate([base, base[:300] + 0.44 * rng.standard_normal((300, 64)), 3 + rng.standard_normal((200, 64)), spiked, 1e-30 * base[:40], base[:40]]).astype(np.float32)
    vectors[-40:, 0], vectors[:40, 0] = -0.0, 0.0
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 12)
    np.fill_diagonal(cos, -2)
    best = {(i, j): cos[i, j] for i in range(len(cos)) for j in np.lexsort((np.arange(len(cos)), -cos[i]))[:5].tolist() if cos[i, j] >= 0.9}
    df = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(vectors)], "node_id string, dense array<float>").repartition(5)
    got = {(int(r["node_id"]), int(r["other"])): r["cosine"] for r in neighbors.nearest_nodes(df, 5, 64, 0.9).collect()}
    assert len(best) > 1500 and len(best.keys() & got.keys()) >= 0.99 * len(best)
    assert all(abs(c - cos[pair]) < 1e-9 and c >= 0.9 for pair, c in got.items())
    assert neighbors.nearest_nodes(df.limit(1), 5, 64, 0.9).count() == 0 and neighbors.nearest_nodes(df.limit(0), 5, 64, 0.9).count() == 0


def test_close_vectors_meet_fewer_in_more_cells():
    rng = np.random.default_rng(7)
    vectors = neighbors._unit(rng.standard_normal((8000, 64)))
    beside = rng.standard_normal(vectors.shape)
    beside -= (beside * vectors).sum(1, keepdims=True) * vectors
    partners = 0.9 * vectors + math.sqrt(0.19) * neighbors._unit(beside)
    met = []
    for count in (64, 4096):
        directions = neighbors._unit(rng.standard_normal((count, 64)))
        margin = close._margin(vectors[:4000], np.zeros(64, np.float32), directions, 0.9, 0.98, rng)
        score, other = vectors[4000:] @ directions.T, partners[4000:] @ directions.T
        hit = score >= score.max(1, keepdims=True) - margin
        back = other >= other.max(1, keepdims=True) - margin
        row = np.arange(len(hit))
        assert hit[row, other.argmax(1)].mean() >= 0.97 and (hit[row, other.argmax(1)] | back[row, score.argmax(1)]).mean() >= 0.998
        met.append(float((hit @ np.bincount(score.argmax(1), minlength=count)).mean() / len(hit)))
    assert met[1] < 0.03 < 0.1 < met[0] < 0.3  # a tree of 1,024 cells let a vector meet more than half


def test_every_seed_gets_its_nearest(spark, sf):
    points = latest_rows(spark.read.parquet(f"{sf}/points.parquet").select("node_id", "dense", F.col("payload.created_at").alias("created_at")), "node_id")
    data = sorted((r["node_id"], r["dense"]) for r in points.collect() if r["dense"] and len(r["dense"]) == 64 and np.isfinite(r["dense"]).all() and any(r["dense"]))
    unit = np.array([v for _, v in data], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 12)
    seeds = {x for r in spark.read.parquet(f"{sf}/rag_results.parquet").collect() for x in r["seed_node_ids"] or []}
    wanted = {(a, data[j][0], r + 1) for i, (a, _) in enumerate(data) if a in seeds for r, j in enumerate(sorted((j for j in range(len(data)) if j != i), key=lambda j: (-cos[i, j], j))[:5])}
    got = QUERIES["p2_seeds"](spark, sf)
    assert got.columns == ["node_id", "other", "cosine", "rank"] and set(rows(got, "node_id", "other", "rank")) == wanted and len(wanted) >= 50


def test_chi_square():
    assert abs(neighbors.chi_square_quantile(2, 0.95) - 5.991) < 0.01 and abs(neighbors.chi_square_quantile(12, 0.95) - 21.026) < 0.01


# --- 3 distinctive terms ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_df", [None, 2])
def test_distinctive_terms(spark, max_df):
    texts = {"a": "lift lift drag lift x1", "b": "drag lift drag wing", "c": "wing wing wing", "d": None, "e": ""}
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "id string, text string, docs int")
    words = {k: plain.words(v) for k, v in texts.items()}
    freq = Counter(t for w in words.values() for t in set(w) if t.isalpha())
    expected = set()
    for k, w in words.items():
        for t, n in Counter(w).items():
            if t.isalpha() and n >= 2 and (max_df is None or freq[t] <= max_df):
                near = {w[j] for i, x in enumerate(w) if x == t for j in range(max(0, i - 3), min(len(w), i + 4))} - {t}
                expected.add((k, t, n, freq[t], len(near), round(len(near) * math.log(6 / freq[t]), 9)))
    got = distinctive.distinctive_terms(df, min_tf=2, max_df=max_df)
    assert set(rows(got, "id", "term", "tf", "df", "degree", F.round("score", 9))) == expected
    assert distinctive.distinctive_terms(df.limit(0), max_df=max_df).count() == 0


def test_every_term_of_every_chunk_is_scored(spark, sf):
    chunks = latest_rows(spark.read.parquet(f"{sf}/chunks.parquet").select("id", "created_at", "text"), "id")
    wanted = {(r["id"], t, n) for r in chunks.collect() for t, n in Counter(plain.words(r["text"])).items() if t.isalpha()}
    got = rows(QUERIES["p3_scores"](spark, sf), "chunk_id", "term", "tf")
    assert len(got) == len(set(got)) and set(got) == wanted and any(n == 1 for _, _, n in wanted)


# --- 4 fusion -----------------------------------------------------------------------------------------------------


def test_numbers(spark):
    data = [("50%", 0.5), (" 1e3 ", 1000.0), ("nan", None), ("", None), ("-", None), (None, None), ("inf", None), ("1e999", None), (".5", 0.5), ("7 %", 0.07)]
    df = spark.createDataFrame(data, "t string, w double")
    assert [r[0] for r in df.select(fusion.read_number(F.col("t"))).collect()] == [w for _, w in data]
    one = spark.createDataFrame([("1,234", "0,5")], "a string, b string").select(fusion.read_number(F.col("a"), "thousands"), fusion.read_number(F.col("b"), "decimal")).first()
    assert tuple(one) == (1234.0, 0.5)


def test_fusion(spark):
    data = [("s", "a", 9.0, 1.0), ("s", "b", 9.0, 5.0), ("s", "c", None, float("nan")), ("s", "b", 9.0, 5.0), ("t", "z", 1.0, None), (None, "q", 1.0, 1.0)]
    df = spark.createDataFrame(data, "src string, item string, g double, i double")
    got = {(r["src"], r["item"]): r for r in fusion.fuse_rankings(df, "src", "item", ["g", "i"]).collect()}
    assert set(got) == {("s", "a"), ("s", "b"), ("s", "c"), ("t", "z")}
    a, b, c = got["s", "a"], got["s", "b"], got["s", "c"]
    assert (a["rank_g"], a["ties_g"], a["rank_i"], b["rank_i"]) == (1, 2, 2, 1) and (b["position"], a["position"], c["position"]) == (1, 2, 3)
    assert c["fused"] == 0 and abs(b["fused"] - 2 / 61) < 1e-12 and a["n_items"] == 3
    assert fusion.fuse_rankings(df.limit(0), "src", "item", ["g", "i"]).count() == 0


def test_large_groups_rank_alike(spark):
    rng = random.Random(4)
    data = [(f"s{rng.randrange(3)}", f"i{i}", rng.choice([None, float("nan"), 1.0, 2.0, rng.random()]), float(rng.randrange(6))) for i in range(200)] + [("s0", "i0", 9.0, 9.0)]
    df = spark.createDataFrame(data, "src string, item string, g double, i double")
    one, other = (rows(fusion.fuse_rankings(df, "src", "item", ["g", "i"], group_limit=n)) for n in (1000, 60))
    assert one == other == rows(fusion.fuse_rankings(df, "src", "item", ["g", "i"], group_limit=0))


# --- 5 documented functions ---------------------------------------------------------------------------------------

CODE = '''import x
def plain(): return 1
@deco(
    "def not_this(): pass"
)
async  def outer(a, b=(1, "):"), *,
          c: "x" = {}) -> dict[str, int]:
    # comment first
    r"""Tells \\d things."""
    if a:
        def inner():
            "joined " 'text'
    class Deep:
        def m(self): ("""wrapped""")
        def n(self):
            f"no {doc}"
        def o(self): b"no"
    try:
\tpass
    except E: pass
class A(B):
    """class doc"""
    x = """
def fake():
    'no'
"""
    def say(self): "Says it aloud."; return 1
    def not_doc(self):
        "a" % 1
    @property
    def \\
      odd[T](self) -> int: \\
        "Odd but fine."
def say(): """Say."""
def args(p, q):
    """
    :param p: int
    :return:
    """
'''


def truth(source, module):
    out = set()

    def walk(node, scope):
        for c in ast.iter_child_nodes(node):
            name = scope
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{scope}.{c.name}"
                doc = ast.get_docstring(c, clean=False)
                if not isinstance(c, ast.ClassDef) and doc is not None:
                    out.add((name, c.lineno, doc))
            walk(c, name)

    walk(ast.parse(source), module)
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_grammar_agrees_with_syntax_tree(end):
    source = CODE.replace("\tpass", "        pass").replace("\n", end)
    got = {(q, line, doc) for q, _, _, doc, line, _, _ in doc_pairs.extract("m.py", source)}
    assert got == {t for t in truth(source, "m") if t[0] not in ("m.say", "m.args")}
    assert len(got) == 5


def test_grammar_on_the_standard_library():
    for module in (ast, random, doc_pairs):
        source = open(module.__file__, encoding="utf-8").read()
        got = {(q, line) for q, _, _, _, line, _, _ in doc_pairs.extract("m.py", source)}
        wanted = {(q, line) for q, line, doc in truth(source, "m")}
        assert got <= wanted and len(got) > 0.7 * len(wanted)


@pytest.mark.parametrize("doc", ["...", "TODO", "N/A", "Write docs here", "docstring", "To be documented.", "No documentation available.", "the_thing()", "The Thing.", "Args:\n  rows: int\nReturns:", ":param rows:\n:return: bool", "---", "TODO: add docstring", "(no docs)", "undocumented", "todo: document", "TBD.", "Docstring goes here.", "Not applicable", "Keine Beschreibung vorhanden."])
def test_uninformative(doc):
    assert doc_pairs.uninformative(doc, "the_thing", "(self, rows: int)", "")


@pytest.mark.parametrize("doc", ["TODO: speed this up. Reads all.", "Returns the rows sorted.", "Make the thing.", "Note the missing wing.", "Describe the document.", "Write null in the text.", "Insert the missing document here.", "Add the missing comments."])
def test_informative(doc):
    assert not doc_pairs.uninformative(doc, "the_thing", "(self, rows: int)", "")


def test_deep_nesting():
    source = "def top():\n  'Reads it all.'\n  x = " + "(" * 190 + "1" + ")" * 190 + "\n"
    source += "".join(" " * i + f"def f{i}():\n" for i in range(95)) + " " * 95 + "'Reads the deepest.'\n"
    assert {q for q, *_ in doc_pairs.extract("m.py", source)} == {t[0] for t in truth(source, "m")}


def test_other_language_and_awkward_files(spark):
    js = "// a\n/** Adds two\n * numbers. */\nexport function add(a, b) { return a + b }\n/** TODO */\nfunction f() {}\nclass K { /** Runs it all. */ async run(x) { } }"
    data = [("1", "a.js", js, 0), ("2", "b.py", "def f(:", 0), ("3", None, "x", 0), ("4", "c.py", None, 0), ("5", "d.py", "", 0), ("6", "e.md", CODE, 0), ("7", "f.py", "(" * 5000, 0), ("8", "g/__init__.py", 'def f():\n  "Does much."', 0)]
    df = spark.createDataFrame(data, "file_id string, path string, content string, name int")
    assert rows(doc_pairs.documented_functions(df), "file_id", "qualified_name", "start_line") == [("1", "a.add", 4), ("1", "a.run", 7), ("8", "g.f", 1)]
    assert doc_pairs.documented_functions(df.limit(0)).count() == 0


# --- 6 near duplicates --------------------------------------------------------------------------------------------


def jaccard_pairs(texts, kind, t):
    n = int(kind[1:])
    sets = {}
    for k, text in texts.items():
        units = plain.words(text)
        units = " ".join(units) if kind[0] == "c" else units
        sets[k] = {tuple(units[i : i + n]) for i in range(len(units) - n + 1)}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) * 10 >= round(t * 10) * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("kind", "t"), [("w3", 0.6), ("c3", 0.6), ("w5", 0.8)])
def test_similar_pairs_match_brute_force(spark, kind, t):
    rng = random.Random(5)
    texts = {}
    for i in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 30, 60, 400]))]
        texts[f"k{i}_0"] = " ".join(words)
        for j in range(1, rng.choice([1, 3, 4])):
            edited = list(words)
            for _ in range(rng.choice([0, 1, 3, 6])):
                edited[rng.randrange(len(edited))] = "new"
            texts[f"k{i}_{j}"] = " ".join(edited)
    texts |= {"null": None, "empty": "", "short": "one"}
    data = [(kind, k, 2.0, v) for k, v in texts.items()] + [(kind, "k0_0", 1.0, texts["k1_0"]), (kind, "null", 1.0, texts["k1_0"]), (kind, None, 1.0, "a b c d e")]
    df = spark.createDataFrame(data, "kind string, key string, version double, text string").withColumn("sig", F.lit(1))
    wanted = jaccard_pairs(texts, kind, t)
    got = rows(near_duplicates.similar_pairs(df, t))
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 20
    groups = {r["key"]: r["group"] for r in near_duplicates.similar_groups(df, t).collect()}
    assert all(groups[a] == groups[b] for a, b in wanted)
    parent = {k: k for k in groups}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in wanted:
        parent[root(a)] = root(b)
    assert len(set(groups.values())) == len({root(k) for k in groups})


def test_a_shingle_of_a_third_of_all_records(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SEGMENT", 5)
    monkeypatch.setattr(near_duplicates, "BUCKET_RECORDS", 20)
    rng = random.Random(9)
    texts = {}
    for i in range(120):
        own = [f"w{rng.randrange(12)}" for _ in range(rng.choice([1, 2, 3]))]
        texts[f"k{i:03d}"] = " ".join((["the", "common", "notice"] if i % 3 == 0 else []) + own)
    df = spark.createDataFrame([("w2", k, 1.0, v) for k, v in texts.items()], "kind string, key string, version double, text string")
    wanted = jaccard_pairs(texts, "w2", 0.4)
    got = rows(near_duplicates.similar_pairs(df, 0.4))
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 30


def test_all_pairs_of_copies_on_demand(spark):
    df = spark.createDataFrame([("w3", f"c{i:02d}", 1.0, "a b c d e") for i in range(40)], "kind string, key string, version double, text string")
    assert near_duplicates.similar_pairs(df, 0.6, expand=None).count() == 40 * 39 // 2


def test_many_copies_are_linked_to_one(spark):
    df = spark.createDataFrame([("w3", f"c{i:03d}", 1.0, "a b c d e f g") for i in range(100)] + [("w3", "other", 1.0, "a b c d e f g h")], "kind string, key string, version double, text string")
    got = rows(near_duplicates.similar_pairs(df, 0.6))
    assert len(got) == 100 and {b for a, b in got if a == "c000"} == {f"c{i:03d}" for i in range(1, 100)} | {"other"}
    assert near_duplicates.similar_pairs(df.limit(0), 0.6).count() == 0


def test_different_texts_of_a_large_class_all_pair(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SALT", 7)
    base = "a b c d e f g"
    texts = {f"c{i:02d}": base.replace(" ", " " * (i + 1)) for i in range(40)} | {"other": base + " h"}
    df = spark.createDataFrame([("w3", k, 1.0, v) for k, v in texts.items()], "kind string, key string, version double, text string")
    got = rows(near_duplicates.similar_pairs(df, 0.6))
    assert len(got) == len(set(got)) == 41 * 40 // 2 and all(a < b for a, b in got)


def test_components(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = dict(rows(near_duplicates.components(spark.createDataFrame(chain, "a string, b string"))))
    assert {got[f"n{i:02d}"] for i in range(31)} == {"n00"} and got["x"] == got["y"] == "x"


# --- 7 packing ----------------------------------------------------------------------------------------------------


def test_tokens(spark):
    df = spark.createDataFrame([("It's a_b x2Ⅷ--?! é",), ("\u00a0",), ("",)], "t string")
    assert [r[0] for r in df.select(F.regexp_extract_all("t", F.lit(packing.TOKEN), F.lit(0))).collect()] == [["It", "'", "s", "a_b", "x2Ⅷ", "--?!", "é"], [], []]


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_holds_every_item(seed):
    rng = np.random.default_rng(seed)
    h = np.bincount(np.clip(rng.gamma(2, 20, 5000).astype(int), 1, 128), minlength=129) if seed == 0 else np.bincount([100, 100, 3, 128, 1], minlength=129)
    plan = packing.plan_containers(h, 128)
    used = np.zeros(129, int)
    for lengths, repeats in plan:
        assert sum(lengths) <= 128
        for v in lengths:
            used[v] += repeats
    assert (used == h).all()
    if seed == 0:
        assert (h * np.arange(129)).sum() / (128 * sum(r for _, r in plan)) > 0.99


def test_containers(spark):
    rng = random.Random(7)
    texts = {i: " ".join(["w"] * rng.choice([1, 5, 30, 30, 64, 65, 200])) for i in range(400)} | {900: None, 901: "", 902: "w " * 1000}
    data = [(k, v, 1) for k, v in texts.items()] + [(1, texts[1], 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, piece int").repartition(3)
    got = packing.pack_containers(df, capacity=64).collect()
    fill = defaultdict(list)
    for r in got:
        if r["container"] is not None:
            fill[r["container"]].append((r["offset"], r["n_tokens"]))
    for spans in fill.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 64
    assert sum(r["n_tokens"] for r in got) == sum(len((v or "").split()) for _, v, _ in data)
    assert {r["doc_id"] for r in got if r["n_pieces"] > 1} == {k for k, v in texts.items() if len((v or "").split()) > 64}
    assert {r["doc_id"] for r in got if r["container"] is None} == {900, 901}
    assert packing.pack_containers(df.limit(0)).count() == 0


# --- 8 leakage ----------------------------------------------------------------------------------------------------


def test_suffix_array_is_sorted():
    ids = np.random.default_rng(0).integers(0, 3, 400).astype(np.int32)
    order = leakage.suffix_array(ids, 16)
    padded = np.append(ids, np.zeros(20, np.int32))
    keys = [tuple(padded[i : i + 8]) for i in order]
    clean = [k for k in keys if 0 not in k]
    assert clean == sorted(clean) and len(order) == (ids > 0).sum()


def test_leaks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    rng = random.Random(8)
    items = {i: [f"v{rng.randrange(12)}" for _ in range(rng.choice([4, 10, 25]))] for i in range(12)}
    items[20] = items[0] + ["tail"] * 10
    docs = {}
    for d in range(60):
        body = [f"v{rng.randrange(12)}" for _ in range(40)]
        for _ in range(rng.choice([0, 1, 2])):
            passage = items[rng.choice(list(items))]
            a = rng.randrange(len(passage))
            at = rng.randrange(40)
            body[at:at] = passage[a : a + rng.choice([9, 10, 20])]
        docs[d] = body
    wanted = set()
    for d, w in docs.items():
        runs = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        wanted |= {(d, k) for k, v in items.items() if any(tuple(v[i : i + 10]) in runs for i in range(len(v) - 9))}
    df = spark.createDataFrame([(d, " ".join(w).upper(), 0) for d, w in docs.items()] + [(900, None, 0), (901, "", 0)], "doc_id long, text string, item_id int")
    tests = spark.createDataFrame([(k, "-".join(v)) for k, v in items.items()] + [(50, None)], "item_id long, text string")
    found = leakage.leaked_passages(df, tests)
    assert set(rows(found.select("doc_id", "item_id").distinct())) == wanted and wanted
    for r in found.collect():
        a, b, n = r["doc_word"], r["item_word"], r["n_words"]
        doc, item = docs[r["doc_id"]], items[r["item_id"]]
        assert n >= 10 and doc[a : a + n] == item[b : b + n] and (a + n == len(doc) or b + n == len(item) or doc[a + n] != item[b + n])
    assert leakage.without_leaks(df, found).count() == 62 - len({d for d, _ in wanted})
    assert leakage.leaked_passages(df, tests.limit(0)).count() == 0 and leakage.leaked_passages(df.limit(0), tests).count() == 0


# --- 9 quality ----------------------------------------------------------------------------------------------------


def test_statistics_bounds():
    for text in (None, "", " \n ", "a", "word " * 50_000, "�÷", "| a | b |\n| 1 | 2 |", "\ud800x"):
        language, values = quality.statistics(text, {"a": "en,fr"})
        assert len(values) == len(quality.STATS) and all(0 <= v <= 1 for v in values)


def test_long_lines_take_no_longer():
    for text in ("." * 200_000 + "x 3", "a " + "1 " * 100_000, "?" * 200_000 + "y", "entry " * 50_000 + "12"):
        assert len(quality.statistics(text, {})[1]) == len(quality.STATS)
    told = {line: (quality._led(line), quality._indexed(line)) for line in ("Wings ..... 12", "Wings . . . xi", "Wings     7", "wing spar, 12, 15-17", "The wing, worn, 12", "12", "x" * 61 + " 3", "Wings 12.")}
    assert [k for k, v in told.items() if v[0]] == ["Wings ..... 12", "Wings . . . xi", "Wings     7"]
    assert [k for k, v in told.items() if v[1]] == ["Wings     7", "wing spar, 12, 15-17"]


def test_tail_scores_are_exact(spark):
    data = [("en" if i % 3 else "fr", *[(i * (k + 3) % 17) / 1000 for k in range(len(quality.STATS))]) for i in range(90)]
    df = spark.createDataFrame(data, "language string, " + ", ".join(f"{s} double" for s in quality.STATS))
    tables = quality.tail_tables(df)
    for language in ("en", "fr"):
        own = [r for r in data if r[0] == language]
        for k, s in enumerate(quality.STATS):
            column = [r[1 + quality.STATS.index(s)] for r in own]
            for v in set(column):
                left, right = tables[language][k, round(v * 1000)]
                assert left == pytest.approx(-math.log(sum(x <= v for x in column) / len(column)), abs=1e-6) and right == pytest.approx(-math.log(sum(x >= v for x in column) / len(column)), abs=1e-6)


def test_kinds_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/doc_labels.parquet").dropDuplicates()
    told = documents.join(labels, "doc_id", "left_semi")
    half = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    kinds = quality.text_kinds(told, spark.read.parquet(f"{data}/common_words.parquet"), half)
    rest = labels.join(half, "doc_id", "left_anti").select("doc_id", F.lower(F.trim("label")).alias("label")).join(kinds, "doc_id")
    right = rest.agg(F.avg((F.col("label") == F.col("kind")).cast("double"))).first()[0]
    assert right > 0.93  # about one label in twenty is wrong


def test_kinds_awkward(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "The wing is worn.", "z")], "doc_id long, text string, kind string")
    common = spark.createDataFrame([("en", "the"), ("en", "is"), (None, "x"), ("fr", None)], "lang string, word string")
    none = spark.createDataFrame([], "doc_id long, label string")
    assert rows(quality.text_kinds(df, common, none), "doc_id", "language", "kind") == [(1, "und", "prose"), (2, "und", "prose"), (2, "und", "prose"), (3, "en", "prose")]
    some = spark.createDataFrame([(3, "PROSE "), (2, "junk"), (2, None), (9, "list")], "doc_id long, label string")
    assert quality.text_kinds(df, common, some).count() == 4
    assert quality.text_kinds(df.limit(0), common, some).count() == 0


# --- queries ------------------------------------------------------------------------------------------------------

COLUMNS = {1: "chunk_id level", 2: "node_a node_b", 3: "chunk_id term", 4: "source_id edge_id", 5: "file_id qualified_name start_line", 6: "node_a node_b", 7: "doc_id", 8: "doc_id item_id", 9: "doc_id kind"}


@pytest.mark.parametrize("n", range(1, 10))
def test_found_queries(spark, sf, n):
    got = QUERIES[f"p{n}_found"](spark, sf)
    assert got.columns == COLUMNS[n].split()
    data = rows(got)
    assert len(data) == len(set(data))


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
