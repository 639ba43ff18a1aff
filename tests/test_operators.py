"""Operators against plain restatements and pinned values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.functions import text as tx
from tessera.operators import access, bm25, chunking, dense, evaluation, formatting, fusion, graph, incremental, ranking
from tessera.plans.search import Engine, Settings
from tessera.sources import files as src
from tessera.sources.store import Store
from tessera.streaming import watch


def test_tokens(spark):
    d = spark.createDataFrame([("def getUserName(user_id)",), ("HTTPServer _x__y_ ä€ 😀",), ("",), (None,)], "t string").select(tx.tokenize(F.col("t")).alias("k"))
    got = [r.k for r in d.collect()]
    assert got[0] == ["def", "getusername", "get", "user", "name", "(", "user_id", "user", "id", ")"]
    assert got[1][:3] == ["httpserver", "http", "server"] and "ä" not in got[1] and "€" in got[1]
    assert got[2] == [] and got[3] == []


def test_code_chunks(spark):
    c = chunking.chunk_files(fx.files(spark)).toPandas()
    assert c.chunk_id.is_unique
    py = c[c.file_path == "shop/cart.py"].set_index("symbol_name")
    assert py.loc["Cart", "symbol_type"] == "class" and (py.loc["Cart", "start_line"], py.loc["Cart", "end_line"]) == (12, 16)
    assert py.loc["add", "parent_scope"] == "Cart" and py.loc["add", "context_header"] == "class Cart > def add(self, item: str) -> None"
    assert py.loc["send", "symbol_type"] == "method" and py.loc["fetch", "symbol_type"] == "async_function"
    assert py.loc["total", "context_header"].startswith("@cache def total") and py.loc["total", "start_line"] == 29
    assert list(py.loc["total", "dependencies"]) == ["os", "shop.tax.rate"]
    go = c[(c.file_path == "cmd/main.go")]
    assert set(zip(go.symbol_name, go.symbol_type)) >= {("Cart", "struct"), ("Add", "method"), ("main", "function")}
    assert (c.file_path == "bad/broken.py").sum() == 2  # windows
    assert c[c.file_path == "docs/a.md"].symbol_name.tolist().count("One") == 1 and (c.file_path == "docs/b.md").sum() == 1
    assert (c.file_path == "data/long.yaml").sum() == 3 and (c.file_path == "data/w75.txt").sum() == 1 and (c.file_path == "data/w76.txt").sum() == 2
    assert not c.file_path.isin(["empty.py", "blank.txt"]).any()
    assert c[c.file_path == "tiny.py"].symbol_type.tolist() == ["module"]


@pytest.mark.parametrize("n", [1, 75, 76, 140, 141, 300])
def test_windows_cover_all_lines(spark, n):
    w = chunking.sliding_windows(spark.createDataFrame([("a.txt", "x\n" * n)], fx.FILE_COLUMNS)).toPandas().sort_values("start_line")
    held = set()
    for s, e in zip(w.start_line, w.end_line):
        held |= set(range(s, e + 1))
        assert e - s < 75
    assert held == set(range(1, n + 1))


def test_long_key_block_is_redacted(spark):
    body = "-----BEGIN RSA PRIVATE" + " KEY-----\n" + "ab\n" * 20000 + "-----END RSA PRIVATE" + " KEY-----"
    d = spark.createDataFrame([(body,), (None,), ("",)], "t string").select(tx.redact(F.col("t")).alias("r"))
    assert [r.r for r in d.collect()] == ["[REDACTED_PRIVATE_KEY]", None, ""]


def test_rate_limit_matches_loop(spark):
    rng = np.random.default_rng(3)
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 600, 300)), unit="s")
    d = pd.DataFrame({"request_id": range(300), "client": rng.integers(0, 3, 300), "ts": ts})
    got = access.limit_requests(spark.createDataFrame(d), 3, 60).toPandas().set_index("request_id").allowed
    held: dict = {}
    for i, c, t in d.itertuples(index=False):
        own = [x for x in held.get(c, []) if (t - x).total_seconds() < 60]
        assert got[i] == (len(own) < 3)
        held[c] = own + [t] * (len(own) < 3)


def test_knn_is_exact(spark):
    v = np.random.default_rng(1).normal(size=(10, 128)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(f"v{i}", [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id string, embedding array<float>")
    top = dense.knn(d, d.where("chunk_id = 'v0'").withColumnRenamed("chunk_id", "query_id"), 3).orderBy("rank").collect()
    assert top[0].chunk_id == "v0" and abs(top[0].score - 1) < 1e-4 and len(top) == 3
    with pytest.raises(Exception):
        dense.checked(d, 64).collect()


def test_pooling_and_encoding(spark):
    d = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "t array<array<double>>, m array<double>")
    assert d.select(dense.mean_pool(F.col("t"), F.col("m")).alias("p")).first().p == [2.0, 3.0]

    class Count:
        dim = 2

        def encode(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    e = dense.encode(spark.createDataFrame([("a", "xxx"), ("b", "")], "chunk_id string, text string"), Count).toPandas().set_index("chunk_id")
    assert abs(e.embedding["a"][0] / e.embedding["a"][1] - 3) < 1e-5 and abs(np.linalg.norm(e.embedding["b"]) - 1) < 1e-5


def test_fusion_ties_and_modes(spark):
    a = spark.createDataFrame([(1, k + 1, x, 1.0) for k, x in enumerate("abc")], "query_id int, rank int, chunk_id string, score double")
    b = spark.createDataFrame([(1, k + 1, x, 1.0) for k, x in enumerate("bad")], "query_id int, rank int, chunk_id string, score double")
    assert [r.chunk_id for r in fusion.fuse(a, b).orderBy("rank").collect()] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        fusion.fuse_mode("other", a, b)


def test_rerank_falls_back(spark):
    class Fails:
        def score(self, pairs):
            raise RuntimeError

    cols = ["file_path", "language", "parent_scope", "symbol_name", "symbol_type", "context_header", "docstring", "content"]
    d = spark.createDataFrame([(1, "q", 1, "c1", *["x"] * 8), (1, "q", 2, "c2", *["x"] * 8)], "query_id int, query string, rank int, chunk_id string, " + ", ".join(f"{c} string" for c in cols))
    assert [r.rerank_score for r in ranking.rerank(d, Fails).orderBy("rank").collect()] == [1.0, 0.5]


@pytest.mark.parametrize("n", [0, 1, 7, 10])
def test_percentiles(spark, n):
    xs = [float(x * 10) for x in range(n)]
    r = evaluation.latency_stats(spark.createDataFrame([(x,) for x in xs], "ms double")).collect()
    if not n:
        assert not r or (r[0]["count"] == 0 and r[0].below_pct == 100)
        return
    for k, p in evaluation.PERCENTILES.items():
        assert r[0][k] == sorted(xs)[min(int(p * n), n - 1)]


def test_retrieval_metrics(spark):
    rec = [(1, "a.py", "", ["a.py", "b"], ["", ""]), (2, "z", "sym", ["x", "y", "w"], ["", "", "my_sym"]), (3, "no", "", ["x"], ["y"]), (4, "", "", ["x"], ["y"])]
    m = evaluation.retrieval_metrics(spark.createDataFrame(rec, "query_id int, expected_file string, target_symbol string, retrieved_files array<string>, retrieved_symbols array<string>")).first()
    assert (m.hit_1, m.hit_3, m.hit_5) == (0.25, 0.5, 0.5) and abs(m.mrr - (1 + 1 / 3) / 4) < 1e-6


def test_ignore_rules(spark, tmp_path):
    for p in (".git/config", "pkg/__pycache__/a.pyc", "pkg/a.py", "x.log", "skip/b.py", "Makefile", "my_secret.py", "c.cc"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x = 1\r\ny = 2\n")
    (tmp_path / ".gitignore").write_text("# c\n*.log\nskip/\n")
    got = src.read_files(spark, str(tmp_path)).toPandas().set_index("file_path")
    assert sorted(got.index) == ["Makefile", "c.cc", "pkg/a.py"]
    assert got.total_lines["pkg/a.py"] == 2 and "\r" not in got.text["pkg/a.py"]
    with pytest.raises(ValueError):
        src.line_range(src.read_files(spark, str(tmp_path)), "../x")
    assert src.line_range(src.read_files(spark, str(tmp_path)), "pkg/a.py", 2, 2).first().content == "y = 2"


def test_engine_end_to_end(spark, tmp_path):
    root, index = tmp_path / "repo", str(tmp_path / "index")
    root.mkdir()
    (root / "auth.py").write_text('class Login:\n    """Checks passwords."""\n\n    def verify_password(self, user, password):\n        """Verifies the password of a user."""\n        return password == user.secret\n')
    (root / "tax.py").write_text("def apply_tax(x):\n    return x * 1.2\n")
    e = Engine(spark, str(root), index)
    assert e.index()["cache_hit"] is False and e.index()["cache_hit"] is True
    top = e.search(["how is the password of a user verified"], Settings(k=3)).orderBy("final_rank").collect()
    assert top[0].symbol_name == "verify_password" and ":L" in top[0].citation
    (root / "tax.py").unlink()
    (root / "new.py").write_text("def refund(order):\n    return order\n")
    assert e.index()["cache_hit"] is False
    assert {r.file_path for r in e.store.read("chunks").collect()} == {"auth.py", "new.py"}
    assert [r.chunk_id for r in e.store.chunks_by_ids([r.chunk_id for r in e.store.read("chunks").collect()][::-1] + ["none"]).collect()]


def test_debounce_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:00:00.3"), (3, "a", "2024-01-01 00:00:05"), (4, "z", "2024-01-01 01:00:00")], "event_id long, path string, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("key", F.lit("k"))
    d.write.parquet(str(tmp_path / "in"))
    s = watch.debounce(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "key")
    q = s.writeStream.format("memory").queryName("deb").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r.paths) for r in spark.table("deb").collect()}
    assert {("a", "b"), ("a",)} <= got
    assert watch.debounce_batch(d, "key").count() == 3


def test_graph_view_and_diff(spark):
    c = graph.graph_chunks(fx.chunks(spark))
    ns, es = graph.view(graph.nodes(c), graph.edges(c), "apply_tax", limit=40)
    assert graph.metrics(ns, es).first().total_nodes == ns.count()
    r = spark.createDataFrame([(1, 1, "shop/t.py", 2, "python")], "query_id int, final_rank int, file_path string, start_line int, language string")
    f = spark.createDataFrame([("shop/t.py", "a\nb\nc\n")], fx.FILE_COLUMNS)
    assert "+# review" in formatting.unified_diffs(r, f).first().diff


def test_paths(tmp_path):
    assert access.safe_path(str(tmp_path / "x"), [str(tmp_path)])
    for bad in ("/etc/passwd", "~/.ssh/id"):
        with pytest.raises(access.ForbiddenPath):
            access.safe_path(bad)
    with pytest.raises(access.ForbiddenPath):
        access.safe_path(str(tmp_path / ".." / "y"), [str(tmp_path)])


def test_many_short_symbols_are_all_answered(spark):
    from tessera.operators import navigation

    requests = spark.createDataFrame([(i, ("q", "ab", "é", "zz")[i % 4]) for i in range(4800)], "request_id long, symbol string")
    rows = [("f", 1, 2, None, "q = ab"), ("g", 3, 4, "q", "q é"), ("h", 5, 6, "x", "a"), ("i", 7, 8, "y", "q"), ("j", 9, 9, "z", ""), ("k", 9, 9, "z", None)]
    chunks = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, symbol_name string, content string")
    got = sorted((r.request_id, r.file_path) for r in navigation.references(requests, chunks).collect())
    assert got == sorted((r.request_id, f) for r in requests.collect() for f, _, _, name, text in rows if r.symbol in (text or "") and name != r.symbol)


def test_knn_native_refuses_what_it_would_cut(spark, monkeypatch):
    import pytest

    from tessera.operators import dense

    monkeypatch.setattr(dense, "MOST_QUERIES", 3)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "chunk_id long, embedding array<float>")
    q = v.withColumnRenamed("chunk_id", "query_id")
    assert dense.knn_native(v, q.where("query_id < 3"), 2).count() == 6
    with pytest.raises(ValueError):
        dense.knn_native(v, q, 2)


@pytest.mark.parametrize(
    "language, line, name, kind",
    [
        ("typescript", "export   default\tclass  Foo {", "Foo", "class"), ("typescript", "const add = async (a, b) => {", "add", "function"), ("javascript", "export async function* walk() {", "walk", "function"),
        ("go", "func  (c *Cart)  Add(x int) {", "Add", "method"), ("go", "type\tCart  struct {", "Cart", "struct"), ("rust", "pub(crate)  async fn go() {", "go", "function"), ("rust", "impl<T>  Show for Cart<T> {", "Cart", "class"),
        ("java", "public static final   class Foo {", "Foo", "class"), ("java", "public List<String> names(int k) {", "names", "method"), ("csharp", "internal sealed  record Foo(int X);", "Foo", "class"),
        ("kotlin", "enum  class Color {", "Color", "enum"), ("kotlin", "override suspend fun run() {", "run", "function"), ("c", "static int  add(int a, int b)", "add", "function"), ("cpp", "enum class  Color {", "Color", "enum"),
        ("sql", "create  or replace\ttable  if not exists a.b (", "a.b", "struct"), ("swift", "public  final class Foo {", "Foo", "class"), ("ruby", "def self.ok?", "ok?", "function"), ("php", "abstract  class Foo", "Foo", "class"), ("scala", "case  class Foo(x: Int)", "Foo", "class"),
    ],
)
def test_declarations(language, line, name, kind):
    found = chunking.structure_symbols("f", language, line + "\n\n")
    assert [(x[2], x[3]) for x in found] == [(name, kind)]


def test_declarations_leave_statements_alone():
    for language, line in (("c", "return add(a, b)"), ("java", "return new Foo(a) {"), ("go", "function x"), ("typescript", "classify(x)"), ("c", "else if (x)")):
        assert chunking.structure_symbols("f", language, line + "\n\n") == []


def test_missing_model_is_a_typed_error(spark):
    def make():
        raise OSError("no such model")

    with pytest.raises(dense.ModelUnavailable, match="no such model"):
        dense.encode(spark.createDataFrame([("a", "x")], "chunk_id string, text string"), make)


def test_benchmark_report(spark, tmp_path):
    from tessera.plans import benchmark

    tree = benchmark.source_tree(spark, 2000).toPandas()
    assert tree.total_lines.sum() >= 2000 and tree.file_path.is_unique and set(tree.language) == {"python", "typescript", "go", "markdown"}
    report = benchmark.run(spark, str(tmp_path / "index"), lines=800, count=2)
    assert report["quality"]["queries"] == 2 and report["quality"]["mrr"] > 0 and set(report["latency"]) == {"analysis_ms", "dense_ms", "sparse_ms", "refinement_ms", "total_ms"}
    benchmark.write_report(spark, report, str(tmp_path / "report"))
    assert "lines_per_second" in spark.read.json(str(tmp_path / "report")).columns


def test_watched_changes_reach_the_index(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def apply_tax(x):\n    return x * 1.2\n")
    (root / "b.py").write_text("def refund(order):\n    return order\n")
    (root / "c.py").write_text("def stays(order):\n    return order\n")
    e = Engine(spark, str(root), str(tmp_path / "index"))
    e.index()
    (root / "b.py").unlink()
    (root / "a.py").write_text("def apply_discount(x):\n    return x * 0.8\n")
    handle = watch.delta_handler(e.store, chunking.chunk_files, lambda paths: src.read_files(spark, str(root)).join(paths, "file_path", "left_semi"))
    handle(spark.createDataFrame([(["a.py", "b.py"],)], "paths array<string>"), 0)
    fresh = Engine(spark, str(root), str(tmp_path / "other"))
    fresh.index()
    rows = lambda d, *by: sorted(map(tuple, d.select(*by).collect()))
    assert rows(e.store.read("chunks"), "chunk_id", "content") == rows(fresh.store.read("chunks"), "chunk_id", "content")
    assert rows(e.store.read("files"), "file_path", "file_hash") == rows(fresh.store.read("files"), "file_path", "file_hash")
    for table, by in (("postings", ("chunk_id", "term", "tf")), ("docs", ("chunk_id", "dl")), ("terms", ("term", "df"))):
        assert rows(getattr(e.store.lexical(), table), *by) == rows(getattr(fresh.store.lexical(), table), *by)


def test_watch_folder_streams_new_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    (root / "deep" / "a.py").write_text("x = 1\n")
    seen: list = []
    for _ in range(2):
        q = watch.apply_stream(watch.watch_folder(spark, str(root)), lambda d, n: seen.extend((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in d.collect()), str(tmp_path / "checkpoint"), availableNow=True)
        assert q.awaitTermination(60)
        (root / "b.py").write_text("y = 2\n")
    assert seen == [("a.py", b"x = 1\n"), ("b.py", b"y = 2\n")]


def test_summary_scores_round_as_printf_does(spark):
    import duckdb

    # decimal ties: stored a little lower, a little higher or exactly in the middle; and a carry
    scores = [65.61495, 12.34565, 1.00005, 0.00015, 0.00005, 0.03125, 0.09375, 99999.99995, 2.0, -65.61495, -0.00001]
    rows = [(1, k, f"a/{k}", x, "en", None, None, "t") for k, x in enumerate(scores, 1)]
    d = spark.createDataFrame(rows, "query_id int, final_rank int, citation string, score double, language string, context_header string, symbol_name string, content string")
    got = formatting.markdown_summary(d).first().summary.split("\n")[::4]
    want = [duckdb.execute("SELECT printf('%.4f', ?::DOUBLE)", [x]).fetchone()[0] for x in scores]
    assert want[0] == "65.6149"
    assert got == [f"{k}. a/{k} score {x}, en, N/A" for k, x in enumerate(want, 1)]
