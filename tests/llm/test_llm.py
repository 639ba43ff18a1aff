"""The text-preparation operators against brute force, on small fixtures with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import class_lm, fingerprints, jaccard_join, line_dedup, mixing, packing, pii, quality_rules, queries, substring_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \t\n", "en", "a", 3), (4, "one", "xx", "b", 3), (5, "a b c d e f g h i", "en", "b", 17), (6, "A B C D E F G H I", "en", None, 17),
    (7, "rep eat it now or not at all " * 6, "de", "a", 0), (8, "line one\nline one\n\nline two\nline one", "fr", "a", 0), (8, "line one\nline one\n\nline two\nline one", "fr", "a", 0),
    (9, "x" * 5000, "en", "c", 0), (10, "mail a.b@c.de_x@y.org and 1.2.3.4.5.6.7.8 or 300.1.1.1, call +1 (555) 010-9999 or 4111 1111 1111 1111.", "en", "c", 0),
    (11, "😀 ümlaut #$% " * 9, "es", "c", 0), (12, "<|endoftext|> x <|endoftext|>", "en", "c", 0),
]


def docs_of(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return docs_of(spark, [])


# -- quality rules


def base_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    held = {k for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held)


def test_quality_counts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in quality_rules.score_documents(docs_of(spark), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = sorted((r[0], *(b := base_counts(r[1])), b[0] < 20 or 100 * b[4] > 30 * b[0]) for r in ODD)
    assert got == want
    assert quality_rules.score_documents(empty(spark), labels).count() == 0


@pytest.mark.parametrize("k,n,p", [(0, 100, 0.05), (3, 1000, 0.01), (40, 1000, 0.05), (7, 100, 0.05)])
def test_binomial_tail_is_exact(spark, k, n, p):
    q = Fraction(p)
    want = float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))) if k < n * p else 1.0
    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p).alias("t")).first().t
    assert abs(got - want) < 1e-9 * max(want, 1e-3)


def test_cutoffs_limit_false_rejections(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "plain words of prose here " * 5 + ("#" * 60 if i % 3 == 0 else "") + f" w{rng.integers(1e9)}", "en", "a", 0) for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    text = [(r[0], " ".join(f"w{x}" for x in rng.integers(0, 10**6, 30)) + (" ####" * 9 if r[0] % 3 == 0 else ""), *r[2:]) for r in rows]
    d = quality_rules.score_documents(docs_of(spark, text), labels).toPandas().set_index("doc_id")
    assert d.kept[d.index % 3 != 0].mean() > 0.94 and d.kept[d.index % 3 == 0].mean() < 0.05
    kept = quality_rules.filter_documents(docs_of(spark, text).withColumn("n_words", F.lit("clash")), labels)
    assert kept.columns == [*"doc_id text lang source n_chars".split(), "n_words"] and kept.count() == d.kept.sum()


# -- mixing


def test_mixing_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 30)), "en", [None, "a", "b", "c", "ä"][min(4, int(rng.integers(0, 9)))], 0) for i in range(600)]
    d = mixing.mix_plan(docs_of(spark, rows)).toPandas().merge(docs_of(spark, rows).toPandas()[["doc_id", "source"]], on="doc_id")
    sizes = d.groupby("source", dropna=False)["size"].sum()
    names = sorted([x for x in sizes.index if isinstance(x, str)]) + [x for x in sizes.index if not isinstance(x, str)]
    w = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    demand, full, target = 1.5 * sizes.sum(), set(), {}
    while True:
        left, total = demand - sum(2 * sizes[n] for n in full), sum(w[n] for n in names if n not in full)
        target = {n: 2 * sizes[n] if n in full else left * w[n] / total for n in names}
        over = {n for n in names if target[n] > 2 * sizes[n] + 1e-9}
        if not over:
            break
        full |= over
    for n in names:
        own = d[d.source.isna()] if not isinstance(n, str) else d[d.source == n]
        assert abs(own.target.iloc[0] - target[n]) < 1e-6 and abs(own.taken.sum() - target[n]) < 1 and (own.taken <= 2 * own["size"]).all()
    again = mixing.mix_plan(docs_of(spark, rows).repartition(7)).toPandas()
    key = ["doc_id", "taken", "position"]
    assert again[key].sort_values("doc_id").reset_index(drop=True).equals(d[key].sort_values("doc_id").reset_index(drop=True))
    m = mixing.mix_documents(docs_of(spark, rows)).toPandas()
    assert m.columns.tolist() == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert m.text.map(lambda t: len(WORD.findall(t))).sum() == d.taken.sum()
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix_plan(docs_of(spark)).count() == len(ODD)


def test_curriculum_moves_sources(spark):
    t = spark.range(11).select((F.col("id") / 10).alias("y")).select(*(mixing.inverse_demand(F.col("y"), F.lit(k)).alias(f"k{k}") for k in range(3))).collect()
    assert all(abs(r.k1 - i / 10) < 1e-9 for i, r in enumerate(t)) and t[5].k0 < 0.5 < t[5].k2 and t[10].k0 == t[10].k2 == 1.0


def test_mixing_query_reads_the_sorted_mixture(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = ODD + [(i // 2, " w1\tw2\n" * int(rng.integers(0, 30)), "en", [None, "", "a", "b", "c"][i % 5], 0) for i in range(400)]
    docs = docs_of(spark, [*rows, (None, "no id", "en", "a", 0), (None, "no id", "en", "a", 0)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    q = queries.op2_mixing(spark, str(tmp_path))
    # the query's rows come out of the range sort of the mixture, not of the plan alone
    assert "rangepartitioning" in q._jdf.queryExecution().executedPlan().toString()
    want = mixing.mix_plan(docs)
    assert q.dtypes == want.dtypes
    flat = lambda d: sorted(map(tuple, d.collect()), key=repr)
    got = flat(q)
    assert got == flat(want) and any(r[4] == 0 for r in got) and any(r[4] > r[1] for r in got)
    # its words are those of the texts in the mixture, cut ones included
    words = Counter()
    for r in mixing.mix_documents(docs).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    own = Counter()
    for r in got:
        own[r[0]] += r[4]
    assert +words == +own
    assert mixing.mix_digest(empty(spark)).count() == 0


# -- packing


def test_packing_round_trip(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = ODD + [(100 + i, "some longer text of words " * (37 * i), "en", "a", 0) for i in range(40)]
    d = packing.pack_documents(docs_of(spark, rows)).toPandas()
    ids = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    assert sum(d.length) == sum(len(ids[r[0]]) for r in rows)
    for r in d.itertuples():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for _, g in d.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert packing.pack_documents(empty(spark)).count() == 0


def test_column_generation_is_tight():
    rng = np.random.default_rng(1)
    sizes = packing.class_sizes()
    lengths = np.minimum(1024, np.maximum(1, rng.lognormal(5.5, 1, 20000).astype(int)))
    used, demand = np.unique(np.searchsorted(sizes, lengths), return_counts=True)
    plan = packing.solve(sizes[used], demand.astype(float))
    assert (sum(a * n for a, n in plan) == demand).all() and all(a @ sizes[used] <= 2048 for a, _ in plan)
    assert lengths.sum() / 2048 / sum(n for _, n in plan) > 0.97


# -- Jaccard join


def brute_groups(rows):
    sets = []
    for r in rows:
        ws = WORD.findall((r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        out.append((r[0], len(sets[i]), min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) if sets[i] else r[0]))
    return sorted(out)


def test_jaccard_groups_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(40)]
    rows = list(ODD)
    for g in range(12):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(int(rng.integers(20, 120)))]
        for k in range(int(rng.integers(1, 14))):
            ws = list(base)
            for _ in range(int(rng.integers(0, 4))):
                ws[int(rng.integers(0, len(ws)))] = f"e{rng.integers(0, 9999)}"
            if rng.random() < 0.5:
                at = int(rng.integers(0, len(ws)))
                ws[at:at] = passage
            rows.append((1000 + 50 * g + k, " ".join(ws), "en", "a", 0))
    want = brute_groups(rows)
    assert sorted(map(tuple, jaccard_join.group_documents(docs_of(spark, rows)).collect())) == want
    monkeypatch.setattr(jaccard_join, "FREQUENT", 5)  # cells count as crowded, passages as frequent
    assert sorted(map(tuple, jaccard_join.group_documents(docs_of(spark, rows)).collect())) == want
    left = jaccard_join.one_of_each(docs_of(spark, rows))
    assert left.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id for r in left.collect()} == {c for _, _, c in want}


def test_jaccard_on_nothing(spark):
    assert jaccard_join.group_documents(empty(spark)).count() == 0


# -- personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_personal_data_base_spans(spark):
    rng = np.random.default_rng(4)
    alphabet = list("0123456789") * 3 + list("+@.-() ab_%é😀\n")
    rows = ODD + [(1000 + i, "".join(rng.choice(alphabet, int(rng.integers(1, 200)))), "en", "a", 0) for i in range(300)] + [(5000, "1 " * 30000 + "1." * 30000 + "a@" + "b." * 20000 + "c", "en", "a", 0)]
    got = {(r.doc_id, r.base_sha256): r for r in pii.span_digest(docs_of(spark, rows)).collect()}
    for r in rows:
        spans = base_spans(r[1] or "")
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()
        found = got[r[0], digest]
        n = Counter(x[2] for x in spans)
        assert (found.n_email, found.n_ip, found.n_card, found.n_phone) == tuple(n[k] for k in BASE)
        assert {f"{k}:{s}:{e}" for s, _, k, e in spans} <= set(found.spans.split(",")) | {""}
    assert pii.span_digest(empty(spark)).count() == 0


def test_added_spans_need_checksum_or_context(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 here", "en", "a", 0), (2, "IBAN GB82 WEST 1234 5698 7654 33 here", "en", "a", 0), (3, "my ssn is 123-45-6789 ok", "en", "a", 0), (4, "part 123-45-6789 ok", "en", "a", 0)]
    got = {r.doc_id: r.spans for r in pii.span_digest(docs_of(spark, rows)).collect()}
    assert "iban:5:32" in got[1] and "iban" not in got[2] and "ssn:10:21" in got[3] and "ssn" not in got[4]


# -- lines, URLs, sentences


def test_recurring_lines_go(spark):
    rng = np.random.default_rng(3)
    body = lambda: "\n".join(" ".join(f"w{x}x".replace("0", "o") + "qzkv"[x % 4] for x in rng.integers(0, 10**6, 12)) for _ in range(6))
    rows = [(i, f"Page {i} of 99 printed today\n" + body() + "\nAll rights kept", "en", "a", 0) for i in range(30)] + [(900 + i, "same one here\nsame two here", "en", "a", 0) for i in range(20)] + ODD
    d = line_dedup.line_digest(docs_of(spark, rows)).toPandas()
    own = d[d.doc_id < 30].drop_duplicates("doc_id").set_index("doc_id")
    first = [i for i in range(30) if i not in {r[0] for r in ODD}]
    assert (own.n_dropped[first] == 2).all() and not own.text[first].str.contains("Page|rights").any()
    assert (d[d.doc_id >= 900].n_dropped == 0).all() and len(d) == len(rows)
    assert line_dedup.line_digest(empty(spark)).count() == 0
    assert line_dedup.drop_lines(docs_of(spark).withColumn("form", F.lit(1))).columns[-3:] == ["form", "__lines", "__dropped"]


def some_body(rng, n=6):
    return "\n".join(" ".join(f"b{x}".translate(str.maketrans("0123456789", "abcdefghij")) for x in rng.integers(0, 10**6, 12)) for _ in range(n))


def test_lines_with_variable_words_go(spark):
    rng = np.random.default_rng(4)
    name = [f"name{c}{d}" for c in "abcdef" for d in "uvwxyz"]
    kinds = [lambda x: f"Posted by reader {x} this morning", lambda x: f"Sent in by {x} with kind regards", lambda x: f"Sent in by our old correspondent {x}"]
    rows = [(i, kinds[i % 3](name[i]) + "\n" + some_body(rng), "en", "a", 0) for i in range(36)]
    rows += [(100 + i, f"Seen here by {name[i]} only\n" + some_body(rng), "en", "a", 0) for i in range(9)]
    d = line_dedup.line_digest(docs_of(spark, rows)).toPandas().set_index("doc_id")
    assert (d.n_dropped[d.index < 36] == 1).all() and (d.n_dropped[d.index >= 100] == 0).all()


def test_mostly_boilerplate_goes_and_copies_stay(spark):
    rng = np.random.default_rng(6)
    notice = "All rights of this text remain with the house that printed it first"
    rows = [(i, notice + "\n" + some_body(rng, 1 if i < 20 else 6).rsplit(" ", 6 if i < 20 else 0)[0], "en", "a", 0) for i in range(40)]
    base = some_body(rng, 20).split(" ")
    for i in range(30):
        ws = list(base)
        ws[int(rng.integers(0, len(ws)))] = "edited"
        rows.append((100 + i, " ".join(ws) + "\n" + notice, "en", "a", 0))
    d = line_dedup.line_digest(docs_of(spark, rows)).toPandas().set_index("doc_id")
    assert (d.n_dropped == 1).all() and not d.text.str.contains(notice).any()


def test_long_lines_with_variable_words_go(spark):
    rng = np.random.default_rng(7)
    words = some_body(rng, 5).split()
    name = [f"name{c}" for c in "abcdefghijklmnop"]
    rows = [(i, " ".join([*words[:40], name[i], *words[40:]]) + "\n" + some_body(rng, 12), "en", "a", 0) for i in range(16)]
    d = line_dedup.line_digest(docs_of(spark, rows)).toPandas()
    assert (d.n_dropped == 1).all() and not d.text.str.contains("name").any()


def test_leaf_finds_the_best_group():
    rng = np.random.default_rng(8)
    for n in [*range(1, 14), 40]:
        leaf, seeds = line_dedup.Leaf(0.7), []
        for form in range(120):
            tokens = [*"abc", *("xyz"[x] for x in rng.choice(3, n, p=[0.8, 0.1, 0.1]))][:n]
            fits = [(sum(a == b for a, b in zip(t, tokens)), -s) for s, t in seeds]
            most = max((f for f in fits if f[0] / n >= 0.7), default=None)
            assert leaf.template(form, tokens) == (-most[1] if most else form)
            seeds += [] if most else [(form, tokens)]


def test_url_rules_and_model(spark):
    rows = [
        (1, "https://a.example.net/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "HTTP://Example.COM/de/x#t", "example.com", "/de/x", "example.com/de/", "block"),
        (3, "http://x.net", "x.net", "", None, None), (4, "http://x.net/", "x.net", "/", "net/", "block"), (5, "http://ann.org/fr/1", "ann.org", "/fr/1", "org/fr/", "allow"),
        (6, None, "", "", None, None), (7, "no scheme.net/", "", "", None, None), (8, "http://notexample.com/de/x", "notexample.com", "/de/x", None, None), (9, "a://b://c/d?e", "b:", "//c/d", None, None), (10, "http://éX.net/ü", "éx.net", "/ü", "net/", "block"),
    ]
    got = {r.page_id: r for r in url_filter.verdicts(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")).collect()}
    for i, _, host, path, rule, verdict in rows:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in (("allow", "block") if verdict is None else (verdict,))
    held = [("https://www.casino-jackpot-win.info/en/1", 1), ("http://m.adult-porn.example.com/fr/7", 1), ("https://spam-ads.example.org/", 1), ("https://blog.bookreaders.com/en/5", 0), ("http://www.museum-news.info/de/4/", 0), ("https://railstation.example.com/es/9", 0)]
    w = url_filter.train(url_filter.labelled_table(spark))
    h, p = url_filter.host_and_path(F.col("url"))
    scored = spark.createDataFrame(held, "url string, block int").select("block", url_filter.block_probability(h, p, w).alias("p")).collect()
    assert sum((r.p >= 0.5) == bool(r.block) for r in scored) >= 5


def brute_removed(rows):
    seen, gone = {}, {}
    for i, text in sorted({(r[0], r[1] or "") for r in rows}):
        ps = substring_dedup.sentences(text)
        for h, k, n in substring_dedup.spans(ps):
            if seen.setdefault(h, (i, k)) != (i, k):
                gone.setdefault(i, set()).update(range(k, k + n))
    return gone


def test_repeated_sentences_go(spark):
    rng = np.random.default_rng(9)
    sent = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) + ". "
    passage = sent(12) + sent(20) + sent(25)
    rows = [(100 + i, sent(15) + sent(9) + (passage if i % 2 else "") + sent(14) + "\n" + sent(3), "en", "a", 0) for i in range(20)] + ODD
    d = substring_dedup.dedup_digest(docs_of(spark, rows)).toPandas()
    gone = brute_removed(rows)
    for r in d.itertuples():
        assert r.n_removed == len(gone.get(r.doc_id, ()))
    with_it = d[(d.doc_id >= 100)].set_index("doc_id").text.map(lambda t: passage.strip() in t)
    assert with_it.sum() == 1 and with_it[101]
    assert all("".join(substring_dedup.sentences(r[1])) == r[1] for r in rows if r[1])
    assert substring_dedup.dedup_digest(empty(spark)).count() == 0


# -- language model and fingerprints


def test_language_model(spark):
    rng = np.random.default_rng(6)
    words = [[f"{g}{x}" for x in range(30)] for g in ("a", "b")]
    rows = [(i, " ".join(words[(i + k) % 2][int(rng.integers(0, 30))] for k in range(40)), "en", "a", 0) for i in range(400)] + [(9000 + r[0], *r[1:]) for r in ODD]
    d = class_lm.score_documents(docs_of(spark, rows)).toPandas()
    train = Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            train.update([*class_lm.tokens_of(r[1]), None])
    n, v = sum(train.values()), len(train)
    for r in rows:
        ts = [*class_lm.tokens_of(r[1]), None]
        got = d[(d.doc_id == r[0])].iloc[0]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(ts), sum(train[t] > 0 for t in ts), n)
        assert abs(got.base_score - sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts)) < 1e-6
        assert got.held_out == (zlib.crc32(str(r[0]).encode()) % 7 == 2)
    held = d[d.held_out & (d.doc_id < 1000)]
    assert held.score.sum() > held.base_score.sum() + 0.2 * held.n_tokens.sum()  # the alternation is learnt
    assert class_lm.score_documents(empty(spark)).count() == 0


def test_fingerprints(spark):
    rng = np.random.default_rng(8)
    rows = ODD[:8] + [(100 + i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)), "en", "a", 0) for i in range(20)] + [(300, "same text here", "en", "a", 0), (301, "same text here", "en", "a", 0)]
    d = fingerprints.edit_digest(docs_of(spark, rows), ranges=5).toPandas().set_index("doc_id")
    order = sorted(rows, key=lambda r: -r[0])
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", nxt[1] or ""
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        got = d.loc[r[0]]
        assert got.n_chars == len(t) and got.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got.fingerprint == fingerprints.fingerprint(t) and got.edited_fingerprint == fingerprints.fingerprint(e)
        assert abs(got.near_next - fingerprints.likeness([got.fingerprint], [fingerprints.fingerprint(u)])[0]) < 1e-12
    big = d[(d.index >= 100) & (d.index < 120)]
    assert big.near_edited.min() > 0.4 and big.near_next[big.index != 100].max() < 0.3
    assert d.fingerprint[300] == d.fingerprint[301]
    assert fingerprints.edit_digest(empty(spark), ranges=3).count() == 0
    assert fingerprints.edit_digest(docs_of(spark, rows[:1]), ranges=3).count() == 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(1)
    text = lambda: "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 20)) for _ in range(4))
    rows = [(i, text(), "en", "ab"[i % 2], 0) for i in range(40)] + [(100 + i, rows_text, "en", "a", 0) for i, rows_text in enumerate([text()] * 5)] + [(200, "too short", "en", "a", 0)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        assert d.columns == "doc_id text lang source n_chars".split(), name
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert 200 not in set(out.doc_id) and len({100, 101, 102, 103, 104} & set(out.doc_id)) <= 1


# -- every operator: exact ids next to nulls, clashing names, ties, long texts

BIG = (1 << 53) + 1
EDGE = [(BIG, "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3, "en", "a", 0), (None, None, None, None, None), (BIG + 2, "", "en", None, 0), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3, "en", "a", 0)]
#: Names that the operators use themselves.
CLASHES = "row rest id t gone point key n rank target source_size size __id __source __size __q __w __c __s __cut __gone __lines __dropped __sentences __removed first worded k".split()


def clashing(spark, rows):
    d = docs_of(spark, rows)
    return d.select(*d.columns, *(F.lit(j).alias(c) for j, c in enumerate(CLASHES)))


def ids_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_ids_stay_exact_next_to_nulls(spark):
    d, want = docs_of(spark, EDGE), sorted((r[0] is None, r[0] or 0) for r in EDGE)
    for digest in (jaccard_join.group_documents, line_dedup.line_digest, substring_dedup.dedup_digest, class_lm.score_documents, fingerprints.edit_digest, pii.span_digest):
        assert ids_of(digest(d)) == want, digest.__name__
    assert set(ids_of(packing.pack_documents(d))) == set(want)


def test_rows_without_an_id_take_part_in_links(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "a", 0), (None, text + " x", "en", "a", 0), (7, text + " y", "en", "a", 0), (None, "other words stand in this one here", "en", "a", 0)]
    got = [(r.doc_id, r.component_id) for r in jaccard_join.group_documents(docs_of(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, 7), (None, 7), (7, 7), (None, None)], key=repr)
    left = jaccard_join.one_of_each(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == [(False, 7), (True, 0)]


def test_one_of_each_keeps_one_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 0)] * 3 + [(2, text, "en", "a", 0), (5, "quite another text with words of its own", "en", "a", 0), (1, "a third text under an id used before", "en", "a", 0)] + [(9, "", "en", "a", 0)] * 2
    left = sorted((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs_of(spark, rows)).collect())
    assert left == sorted([(1, text), (5, rows[4][1]), (1, rows[5][1]), (9, ""), (9, "")])


def test_columns_with_clashing_names_pass_through(spark):
    d = clashing(spark, EDGE)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for made in (quality_rules.filter_documents(d, labels), mixing.mix_documents(d), line_dedup.drop_lines(d), substring_dedup.dedup_spans(d), jaccard_join.one_of_each(d)):
        assert made.columns[: len(d.columns)] == d.columns
        for r in made.collect():
            assert [r[c] for c in CLASHES] == list(range(len(CLASHES)))
    for digest in (mixing.mix_plan, packing.pack_documents, jaccard_join.group_documents, pii.span_digest, line_dedup.line_digest, substring_dedup.dedup_digest, class_lm.score_documents, fingerprints.edit_digest):
        assert digest(d).count() >= len(EDGE), digest.__name__


def test_packing_of_long_white_space(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    rows = [(1, " " * 2_000_000, "en", "a", 0), (2, "\n" * 1_000_000, "en", "a", 0), (3, " \n" * 600_000 + "x", "en", "a", 0), (4, "a\ud800b".encode("utf-8", "replace").decode(), "en", "a", 0)]
    d = packing.pack_documents(docs_of(spark, rows)).toPandas()
    for i, text, *_ in rows:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = d[d.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))


def test_many_spans_take_linear_time(spark):
    text = "call +1 (017) 555-7713 or 10.0.0.1 now " * 50_000
    r = pii.span_digest(docs_of(spark, [(1, text, "en", "a", 0)])).first()
    assert (r.n_phone, r.n_ip) == (50_000, 50_000)
    spans = base_spans(text)
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()


def test_secrets_are_found(spark):
    token = "04dbebab91ab85687d33" + "eeaaf9ac699e1188f962"
    rows = [(1, f'set token = "{token}" here', "en", "a", 0), (2, f"the word {token} alone stays among plain words", "en", "a", 0), (3, "key " + "AKIA" + "ABCDEFGHIJKLMNOP", "en", "a", 0)]
    got = {r.doc_id: (r.spans, r.n_spans) for r in pii.span_digest(docs_of(spark, rows)).collect()}
    assert got[1] == (f"secret:13:{13 + len(token)}", 1) and got[2] == ("", 0) and got[3][0] == "key:4:24"


def test_running_states_match_a_loop(spark):
    from tessera.llm.common import running

    for n in (0, 1, 3, 4, 5, 17):
        d = spark.createDataFrame([(list(range(n)),)], "xs array<int>").select(running(F.col("xs"), F.lit(10), lambda a, x: a + x, block=4).alias("r"))
        assert d.first().r == [10 + sum(range(k)) for k in range(n)]


# -- independent restatements


def test_certified_cutoffs_restated(spark):
    """kept against a plain loop over grids, strata and exact binomial tails."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 7))))
    rows, labels = [], []
    for i in range(5400):
        bad = i % 3 == 0
        ws = [word() + ("#" if bad and rng.random() < 0.5 else "") for _ in range(25)]
        rows.append((i, " ".join(ws), ("en", "xx")[i % 2], "a", 0))
        labels.append((i, int(not bad), 0))
    d = docs_of(spark, rows)
    got = {r.doc_id: r for r in quality_rules.score_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    feats = {r.doc_id: r["__q"].asDict() for r in quality_rules.with_features(d.select("doc_id", "text", "lang")).collect()}
    held = {r.doc_id: r.h == 0 for r in d.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("h")).collect()}
    alpha, delta = quality_rules.ALPHA / len(quality_rules.GRIDS), quality_rules.DELTA / (len(quality_rules.GRIDS) * (len(quality_rules.STRATA) + 1))

    def tail(k, n):
        p = Fraction(alpha).limit_denominator(10**6)
        return float(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))

    cut = {}
    for s in ("en", "other"):
        own = [(feats[i], q, held[i]) for i, q, _ in labels if feats[i]["stratum"] == s and not feats[i]["base_failed"]]
        for m, grid in quality_rules.GRIDS.items():
            best = (0, None)
            n = sum(1 for f, q, h in own if q and h)
            for c in grid:
                if n == 0 or tail(sum(1 for f, q, h in own if q and h and f[m] > c), n) > delta:
                    break
                gain = sum(1 for f, q, h in own if not q and not h and f[m] > c) - quality_rules.GOOD_COST * sum(1 for f, q, h in own if q and not h and f[m] > c)
                best = max(best, (gain, c), key=lambda x: x[0])
            if best[1] is not None:
                cut[s, m] = best[1]
    assert cut
    for i, r in got.items():
        f = feats[i]
        assert r.kept == (not f["base_failed"] and not any(f[m] > cut.get((f["stratum"], m), math.inf) for m in quality_rules.GRIDS))
    assert sum(not r.kept for r in got.values()) > 100


def test_substring_spans_restated(spark):
    """Sentences and spans by a character loop, without the operator's functions."""
    rng = np.random.default_rng(13)
    sent = [" ".join(f"s{rng.integers(0, 400)}" for _ in range(int(rng.integers(2, 36)))) for _ in range(9)]
    rows = [(i, "".join(sent[int(k)] + rng.choice([". ", ". ", "\n", "! ", ".. "]) for k in rng.integers(0, 9, int(rng.integers(1, 9)))), "en", "a", 0) for i in range(60)]

    def cut(text):
        out, cur, k = [], "", 0
        while k < len(text):
            cur += text[k]
            ends = text[k] == "\n" or text[k] in ".!?" and k + 1 < len(text) and text[k + 1].isspace()
            k += 1
            if ends:
                while k < len(text) and text[k].isspace():
                    cur += text[k]
                    k += 1
                out.append(cur)
                cur = ""
        return out + [cur] * bool(cur)

    seen, gone = {}, {}
    for i, text, *_ in rows:
        pieces = [p.lower().split() for p in cut(text)]
        for a in range(len(pieces)):
            n, b = 0, a
            while b < len(pieces) and not (n >= 30 or b - a >= 2 and n >= 15):
                n += len(pieces[b])
                b += 1
            if n >= 30 or b - a >= 2 and n >= 15:
                name = tuple(map(tuple, pieces[a:b]))
                if seen.setdefault(name, (i, a)) != (i, a):
                    gone.setdefault(i, set()).update(range(a, b))
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in substring_dedup.dedup_digest(docs_of(spark, rows)).collect()}
    assert gone
    for i, text, *_ in rows:
        pieces = cut(text)
        assert got[i] == (len(pieces), len(gone.get(i, ())), "".join(p for k, p in enumerate(pieces) if k not in gone.get(i, ())))


def test_class_moves_raise_the_likelihood_by_what_they_say():
    """The gain of a single move against the likelihood worked out anew from the bigrams."""
    rng = np.random.default_rng(14)
    x = rng.integers(0, 12, 3000)
    x[::7] = 3  # with repeats of a unit next to itself
    x[1::7] = 3
    size, many = 12, 4
    classes = np.concatenate([[0], rng.integers(1, many, size - 1)])

    def tables(c):
        n, own = np.zeros((2, size, many)), np.zeros(size)
        for u, v in zip(x, x[1:]):
            n[0, u, c[v]] += 1
            n[1, v, c[u]] += 1
            own[u] += u == v
        return n, own

    n, own = tables(classes)
    before = class_lm.likelihood(class_lm.class_pairs(n, classes))
    best, gain = class_lm.best_moves(n, own, classes)
    assert (gain > 0).any()
    for u in range(1, size):
        change = {}
        for c in range(1, many):
            moved = classes.copy()
            moved[u] = c
            change[c] = class_lm.likelihood(class_lm.class_pairs(tables(moved)[0], moved)) - before
        assert abs(gain[u] - max(change.values())) < 1e-6 and abs(change[best[u]] - gain[u]) < 1e-6


def test_rare_words_move_by_their_neighbours(spark, monkeypatch):
    """Classes of words that are no units, and scores, by loops over the tokens; joins and broadcasts both used."""
    monkeypatch.setattr(class_lm, "UNITS", 3)
    monkeypatch.setattr(class_lm, "HEAD", 12)
    monkeypatch.setattr(class_lm, "CLASSES", 5)
    monkeypatch.setattr(class_lm, "MOST_NEIGHBOURS", 60)
    rng = np.random.default_rng(21)
    vocabulary = [f"w{k}{'xyz'[k % 3]}" for k in range(40)]
    weights = 1 / np.arange(1, 41)
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 30)), p=weights / weights.sum())), "en", "a", 0) for i in range(60)]
    rows += [(9000, "w39z w39z w39z never seen", "en", "a", 0), (9001, None, "en", "a", 0), (None, "w1y w38z", "en", "a", 0)]
    seen = []
    weighed = class_lm.weighed

    def capture(encoded, rare, model, column):
        seen.append((column, rare.collect(), model))
        return weighed(encoded, rare, model, column)

    monkeypatch.setattr(class_lm, "weighed", capture)
    got = {r.doc_id: r for r in class_lm.score_documents(docs_of(spark, rows)).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = [[*class_lm.tokens_of(r[1]), None] for r in rows if not held(r[0])]
    count = Counter(t for ts in texts for t in ts)
    column, rare, model = seen[-1]
    start = {r.word.encode(): r.start for r in rare} | {w: int(model.unit_classes[k]) for w, k in model.units.own.items()} | {None: 0}
    assert {r.word.encode(): r.c for r in rare} == {w: c for w, c in count.items() if w is not None and w not in model.units.own}

    def pairs(of):
        pair = np.zeros((5, 5))
        for ts in texts:
            for a, b in zip([None, *ts], ts):
                pair[of[a], of[b]] += 1
        return pair

    before = class_lm.likelihood(pairs(start))
    for r in rare:
        gains = {c: class_lm.likelihood(pairs(start | {r.word.encode(): c})) - before for c in range(1, 5)}
        assert gains[r["class"]] >= max(gains.values()) - 1e-6
    of = start | {r.word.encode(): r[column] for r in rare}
    pair = pairs(of)
    assert class_lm.likelihood(pair) >= before - 1e-6 or column == "start"
    for i, text, *_ in rows:
        ts, score, at = [*class_lm.tokens_of(text), None], 0.0, 0
        for t in ts:
            c = of[t] if t in of else int(model.unit_classes[model.units.shared(t)])
            n, kinds = pair[at].sum(), (pair[at] > 0).sum()
            step = (pair[at, c] + kinds * (pair[:, c].sum() + 1) / (pair.sum() + 5)) / (n + kinds)
            score += math.log10(step * (count[t] + 1) / (sum(count[w] + 1 for w in of if of[w] == c) + 1))
            at = c
        assert abs(got[i].score - score) < 1e-9 * len(ts)


def test_fingerprints_restated():
    """Signatures and likeness by loops over characters."""
    rng = np.random.default_rng(15)
    mask = (1 << 64) - 1

    def mixed(v):
        v = (v ^ (v >> 30)) * 0xBF58476D1CE4E5B9 & mask
        v = (v ^ (v >> 27)) * 0x94D049BB133111EB & mask
        return v ^ (v >> 31)

    places = [pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64) | 1 for k in range(7)]

    def cuts(text, level):
        out, start = [], 0
        for k in range(len(text)):
            h = mixed(sum((ord(text[k - j]) + 1) * places[j] for j in range(min(7, k + 1))) & mask)
            if k == len(text) - 1 or h & ((1 << level) - 1) == (1 << level) - 1:
                out.append(text[start : k + 1])
                start = k + 1
        return out

    def indel(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], last if c == d else 1 + min(row[j], row[j - 1])
        return row[-1]

    texts = ["".join(rng.choice(list("abc de\né😀"), int(n))) for n in (1, 6, 40, 63, 64, 65, 300, 700)]
    texts += [texts[-1][:500] + texts[-2], texts[-1][50:]]
    prints = fingerprints.fingerprints(texts)
    for t, p in zip(texts, prints):
        block, one, two = p.split(":")
        level = next(k for k in range(64) if len(cuts(t, k)) <= 64)
        assert int(block) == 1 << level and len(one) == len(cuts(t, level)) and len(two) == len(cuts(t, level + 1))
        pairs = {}
        for piece, letter in zip(cuts(t, level), one):
            assert pairs.setdefault(piece, letter) == letter  # equal chunks, equal letters
    for p in prints:
        for q in prints:
            best = 1.0 if p == q else 0.0
            for i in (1, 2):
                for j in (1, 2):
                    a, b = p.split(":"), q.split(":")
                    if int(a[0]) << i == int(b[0]) << j:
                        s, u = a[i], b[j]
                        short = min(len(s), len(u))
                        run = min(6, max(short // 2, 2) if short > 1 else short)
                        if any(s[k : k + run] in u for k in range(len(s) - run + 1)):
                            best = max(best, 1 - indel(s, u) / (len(s) + len(u)))
            assert abs(fingerprints.likeness([p], [q])[0] - best) < 1e-9
