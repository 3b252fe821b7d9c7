"""Surrogates, packing, HTML, nearest neighbours, and the pipeline."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import best_fit, graph_ann, surrogates, wrapper

KEY = b"test"


@pytest.mark.parametrize("size", [2, 3, 5, 57, 1000])
def test_permutation_without_fixed_points(size):
    cipher = surrogates.Cipher(KEY)
    image = [cipher.move(x, size, "t") for x in range(size)]
    assert sorted(image) == list(range(size)) and all(a != b for a, b in enumerate(image))


def test_formats_are_kept():
    put = lambda kind, value: surrogates.surrogate(kind, value, surrogates.Cipher(KEY))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", put("phone", "+1 (425) 555-5699"))
    assert re.sub(r"\D", "", put("phone", "425-555-5699")) == re.sub(r"\D", "", put("phone", "+1 (425) 555-5699"))[1:]
    card = put("card", "4111 1111 1111 1111")
    assert surrogates._luhn(card.replace(" ", "")) and re.fullmatch(r"(\d{4} ){3}\d{4}", card)
    assert not surrogates._luhn(put("card", "4670349892180624"))
    assert surrogates._iban(put("iban", "DE89 3704 0044 0532 0130 00").replace(" ", ""))
    assert re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}@[a-z]{2}\d\.org", put("email", "John.Doe@mx7.org"))
    assert all(0 <= int(x) < 256 for x in put("ipv4", "21.7.6.143").split("."))
    for (script, gender), names in surrogates.NAMES.items():
        image = {put("given", n) for n in names}
        assert image == set(names), (script, gender)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**10 - 1), st.integers(0, 10**10 - 1))
def test_distinct_entities_stay_distinct(a, b):
    cipher = surrogates.Cipher(KEY)
    form = lambda n: f"{n:010d}"[:3] + "-" + f"{n:010d}"[3:6] + "-" + f"{n:010d}"[6:]
    x, y = surrogates.surrogate("phone", form(a), cipher), surrogates.surrogate("phone", form(b), cipher)
    assert (x == y) == (a == b) and x != form(a)


def test_texts_lose_their_entities(spark, awkward, nothing):
    rows = [(1, "Write to ann.7@mail.example.com or call +1 (425) 555-5699, card 4670349892180623 from 21.7.6.143."), (2, "ann.7@mail.example.com wrote; Anna Müller and Иван Петров met.")]
    out = {r["doc_id"]: r for r in surrogates.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for secret in ("ann.7@mail", "555-5699", "4670349892180623", "21.7.6.143", "Anna", "Müller", "Иван", "Петров"):
        assert all(secret not in r["text"] for r in out.values())
    assert out[1]["n_entities"] == 4 and out[2]["n_entities"] == 5
    mail = re.search(r"\S+@\S+", out[2]["text"])[0]
    assert mail in out[1]["text"]  # the same entity in another document
    plain = surrogates.pseudonymize(awkward, KEY).collect()
    assert [r["text"] for r in plain] == [r["text"] for r in awkward.collect()]
    assert surrogates.pseudonymize(nothing, KEY).count() == 0


def test_other_scripts_and_odd_characters():
    put = lambda kind, value: surrogates.surrogate(kind, value, surrogates.Cipher(KEY))
    new = put("email", "日本²İ@例え.jp")
    assert new.endswith(".jp") and new[2] == "²" and new[:2] != "日本" and "\u4e00" <= new[0] <= "\u9fff"
    assert re.fullmatch("\\+[٠-٩]{1,3} [٠-٩]{3} [٠-٩]{4}", put("phone", "+٤٩ ١٢٣ ٤٥٦٧"))
    assert surrogates.normal("ipv4", "01.2.3.4") == "1.2.3.4"


def _words(text):
    return re.findall(r"[^\W\d_]+", text)


def test_every_mention_goes_and_equal_names_stay_equal():
    """Word by word: no mention of a found name stays at its place, and a name has one surrogate in all documents, whatever the case."""
    rnd = random.Random(5)
    people = [("Anna", "Müller"), ("Karl", "Schwarzenberg"), ("Katarina", "Novak"), ("Zdenka", "Veselova"), ("Иван", "Петров"), ("Ольга", "Петрова"), ("Luis", "García"), ("Pierre", "Dubois")]
    frames = ["Name: {g} {s}. Then {s} spoke, {S} wrote, {g} left; {s}'s hat.", "Dr. {g} {s} and {s}.", "my name is {g} {s}; {G} {S}!", "Dear {g} {s}, hello {g}."]
    made = {}
    for _ in range(200):
        g, s = rnd.choice(people)
        text = " ".join(rnd.sample(frames, 2)).format(g=g, s=s, G=g.upper(), S=s.upper())
        new, _ = surrogates.replace(text, KEY)
        for before, after in zip(_words(text), _words(new), strict=True):
            if before.lower() in (g.lower(), s.lower()):
                assert after.lower() != before.lower()
                assert after.isupper() == before.isupper() and after[0].isupper() == before[0].isupper()
                made.setdefault(before.lower(), set()).add(after.lower())
            else:
                assert after == before
    assert all(len(v) == 1 for v in made.values()) and len(set.union(*made.values())) == len(made)
    (man,), (woman,) = made["петров"], made["петрова"]
    assert woman == man + "а"


#: Texts, and the words in them that are names.
MARKED = [
    ("Lisa Long took a long walk. A long day.", "Lisa Long"),
    ("Peter Black wore black.", "Peter Black"),
    ("Mark the date. mark it.", ""),
    ("Mark the date", ""),
    ("MARK YOUR CALENDARS NOW", ""),
    ("Dear Will, I will come.", "Will"),
    ("Frau Weiß weiß es.", "Weiß"),
    ("I met Anna. Anna left.", "Anna"),
    ("Name: Anna Long. Then it took long.", "Anna Long"),
    ("Mr. Smith spoke; SMITH wrote, Smiths came.", "Smith SMITH Smiths"),
    ("Herr Ch kam. Ch ging.", "Ch"),
    ("姓名：王伟，王伟说。", "王伟 王伟说"),
    ("李娜女士来了。", "李娜女士来了"),
    ("الاسم: محمد علي. قال محمد", "محمد علي"),
    ("שם: דוד כהן. אמר דוד", "דוד כהן"),
]


def _tokens(text):
    return re.findall(r"[^\W_]+|[\W_]", text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*range(9), *range(9, len(MARKED))]), min_size=1, max_size=1), st.text(alphabet="abcdefghij .,\n", max_size=40), st.binary(min_size=1, max_size=4))
def test_no_word_but_a_marked_name_changes(chosen, filler, key):
    text = " ".join([MARKED[k][0] for k in chosen] + [filler])
    names = {w for k in chosen for w in MARKED[k][1].split()}
    new, _ = surrogates.replace(text, key)
    before, after = _tokens(text), _tokens(new)
    assert len(before) == len(after)
    for x, y in zip(before, after, strict=True):
        assert (x != y) == (x in names), (x, y, text, new)


def _brute(text, key):
    """A plain replacement of patterns and of the names of MARKED, in one pass from left to right."""
    known = {w for t, names in MARKED if t in text for w in names.split()}
    kinds = {w: "given" if w in ("Lisa", "Peter", "Will", "Anna") else "surname" for w in known}
    put, out, k = lambda kind, v: surrogates.surrogate(kind, v, surrogates.Cipher(key)), "", 0
    while k < len(text):
        hits = [("email", r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ssn", r"\d{3}-\d{2}-\d{4}(?![\w-])"), *((kinds[w], rf"{w}(?![^\W\d_])") for w in known)]
        found = next(((kind, m) for kind, p in hits if (m := re.compile(p).match(text, k)) and (k == 0 or not re.match(r"[\w.+-]", text[k - 1]))), None)
        out, k = (out + put(found[0], found[1][0]), found[1].end()) if found else (out + text[k], k + 1)
    return out


def test_whole_texts_equal_a_plain_replacement():
    rnd = random.Random(11)
    # Apart from each other by a line, and without words that another one uses in lower case.
    for _ in range(60):
        some = rnd.sample([MARKED[k][0] for k in (1, 5, 7, 8)], 2)
        text = "\n".join([*some, f"Write to a{rnd.randrange(99)}.b@x{rnd.randrange(9)}.org, 123-45-{rnd.randrange(1000, 9999)}."])
        assert surrogates.replace(text, KEY)[0] == _brute(text, KEY)


def test_no_short_name_keeps_its_own_form():
    letters = "abcdefghijklmnopqrstuvwxyz"
    cipher = surrogates.Cipher(KEY)
    for n in (2, 3):
        names = ["".join(x) for x in itertools.product(letters, repeat=n)]
        new = [surrogates.surrogate("surname", x, cipher) for x in names]
        assert all(a != b for a, b in zip(names, new, strict=True)) and len(set(new)) == len(names)


def test_names_of_one_form_are_permuted():
    cipher = surrogates.Cipher(KEY)
    rnd = random.Random(6)
    names = {"".join(rnd.choice("abdeklmnorsüqx") for _ in range(rnd.randint(2, 6))) + rnd.choice(["", "", "er", "ova", "ov", "son"]) for _ in range(5000)}
    for kind in ("given", "surname"):
        new = {n: surrogates.surrogate(kind, n.title(), cipher).lower() for n in names}
        assert len(set(new.values())) == len(names)
        assert all(surrogates._split(kind, n)[1] == surrogates._split(kind, v)[1] and len(n) == len(v) for n, v in new.items() if n not in surrogates._LISTED)


def test_addresses_of_a_domain_stay_together():
    new, _ = surrogates.replace("a.b@mail.example.com c.d@mail.example.com a.b@other.example.org", KEY)
    first, second, third = (x.split("@") for x in new.split())
    assert first[1] == second[1] != third[1] and first[0] == third[0] != second[0]


@pytest.mark.parametrize("text", ["Dear Sir, the Mark of the frank man", "a Professor of Law", "will jack mark the page", "contact: support desk", "Name: the rose"])
def test_ordinary_texts_are_left_alone(text):
    assert [f for f in surrogates.find(text) if text[f[1] : f[2]] not in ("Mark", "Law")] == []


def test_confusions(spark):
    rows = [(name,) for name in surrogates.NAMES["greek", "m"]]
    out = surrogates.confusions(spark.createDataFrame(rows, "text string"), KEY).collect()
    assert [(r["kind"], r["entities"]) for r in out] == [("given", 5)]


def test_clashing_count_column(spark):
    out = surrogates.pseudonymize(spark.createDataFrame([(1, "Anna", "x")], "n_entities long, text string, extra string"), KEY)
    assert out.columns == ["text", "extra", "n_entities"] and out.first()["n_entities"] == 1


def test_a_collision_is_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a@x.org b@x.org")], "doc_id long, text string")
    monkeypatch.setattr(surrogates, "collisions", lambda *_: spark.sql("SELECT 'email' AS kind, 'x' AS surrogate, 2 AS entities"))
    with pytest.raises(ValueError, match="share a surrogate"):
        surrogates.pseudonymize(docs, KEY)


def test_no_collisions(spark):
    rnd = random.Random(1)
    rows = [(i, f"{rnd.choice('abc')}{rnd.randrange(300)}@x{rnd.randrange(9)}.example.com +1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}") for i in range(800)]
    assert surrogates.collisions(spark.createDataFrame(rows, "doc_id long, text string"), KEY).count() == 0


def plain_best_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and source not in b["s"] and cluster not in b["c"]]
        if fits:
            _, k = min(fits)
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        b = bins[k]
        out.append((k, capacity - b["left"]))
        b["left"] -= size
        b["s"] |= {source} - {None}
        b["c"] |= {cluster} - {None}
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 6))), max_size=80))
def test_best_fit_equals_a_full_search(items):
    items = sorted(items, key=lambda t: -t[0])
    assert list(best_fit.best_fit(items, 20)) == plain_best_fit(items, 20)


def test_packing(spark, awkward, nothing):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([3, 30, 90, 250]))), f"s{int(rnd.random() ** 3 * 6)}") for i in range(300)]
    rows += [(1000 + i, rows[5][1], "hot") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = best_fit.pack(docs, capacity=100, shard_words=5_000).collect()
    assert sum(r["n_words"] for r in out) == sum(len(t.split()) for _, t, _ in rows)
    text, source, bins = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}, {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
    for some in bins.values():
        spans = sorted((r["start"], r["start"] + r["n_words"]) for r in some)
        assert spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len({source[r["doc_id"]] for r in some}) == len(some) and len({text[r["doc_id"]] for r in some}) == len(some)
    odd = best_fit.pack(awkward).collect()
    assert len(odd) == 11 + 4 and {r["doc_id"] for r in odd if r["bin_id"] is None} == {3, 4, 5}
    assert best_fit.pack(nothing).count() == 0


PAGE = "<html><body><div class='x'>Welcome to the site</div><nav><a>m</a></nav><article><h1>Title {k}</h1><p>Body {k} &amp; more<br>text<div>Subscribe to our letter now</div></article><div id=comments>c</div><p>All rights reserved</p></body></html>"


def test_tree_matching_is_the_largest():
    def tree(spec):
        node = wrapper.Node(spec[0])
        for c in spec[1:]:
            node.add(tree(c))
        return node

    a = tree(("a", ("b",), ("c", ("d",), ("e",)), ("b",)))
    b = tree(("a", ("c", ("e",)), ("b",), ("f",)))
    assert len(wrapper.match(a, b)) == 4
    assert wrapper.match(a, tree(("z",))) == []


@pytest.mark.parametrize("most", [0, wrapper.BROADCAST_BYTES])
def test_wrapper_drops_what_a_host_repeats(spark, most):
    rows = [(k, f"http://h.example/{k}", PAGE.format(k=k)) for k in range(6)] + [(9, "http://other.example/", PAGE.format(k=9)), (10, None, PAGE.format(k=10)), (11, "http://h.example/x", None)]
    out = {r["page_id"]: r for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")), broadcast_bytes=most).collect()}
    assert out[3]["text"] == "Title 3\nBody 3 & more text" and out[3]["n_chars"] == len(out[3]["text"])
    assert out[9]["text"].endswith("Subscribe to our letter now")  # nothing to compare with
    assert out[11]["text"] == "" and out[11]["n_chars"] == 0 and len(out) == 9


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<b>b</p><p>c", "ab\nc"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<script>var t='</p>'</script><style>p{}</style><p>x &eacute;&nbsp; y", "x é y"),
        ("<ul><li>one<li>two</ul>tail", "one\ntwo\ntail"),
        ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside></article><footer>f</footer>", "T\nx"),
        ("<form><p>no</p></form><div class='cookie-notice'>no</div><p>yes</p>", "yes"),
        ("<p>cut <a href='x", "cut"),
    ],
)
def test_markup(html, text):
    assert wrapper.main_text(wrapper.parse(html)) == text


def _recall(rows, found, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    hits = 0
    for q in [i for i in ids if i % 20 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:k]])
        hits += len(best & {r["vec_id"] for r in found if r["query_id"] == q})
    return hits / (k * len([i for i in ids if i % 20 == 0]))


def test_neighbours_recall(spark):
    rnd = np.random.default_rng(0)
    rows = [(int(i), [float(c) for c in rnd.normal(size=16) * rnd.uniform(0.5, 2)]) for i in range(1500)]
    found = graph_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=10, shard_rows=600).collect()
    assert _recall(rows, found, 10) > 0.95
    x = dict(rows)
    assert all(abs(r["score"] - np.dot(x[r["query_id"]], x[r["vec_id"]])) < 1e-12 for r in found)


@pytest.mark.parametrize("norms", [(1e-3, 1e6), (1.0, 1.0), (1e-140, 1e-135), (1e140, 1e143)])
def test_neighbours_of_unequal_norms(spark, norms):
    """Recall holds with norms over nine powers of ten, and in sets far from zero; many shards, so that pivots and bounds are used."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2000, 12)) + 3 * rnd.normal(size=(8, 12))[rnd.integers(0, 8, 2000)]
    x *= np.exp(rnd.uniform(*np.log(norms), 2000))[:, None] / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = graph_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20, shard_rows=150).collect()
    assert _recall(rows, found, 20) >= 0.95


def test_neighbours_with_one_long_vector_and_tight_groups(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[700] *= 1e4
    x[1000:] = x[1000] * 5 + 1e-6 * rnd.normal(size=(500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 2.0]), (5020, [9.0] * 17)]
    found = graph_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20, shard_rows=400).collect()
    assert _recall(rows[:1500], found, 20) >= 0.95
    assert not {r["query_id"] for r in found} & {5000, 5020}


def test_shard_bounds_hold(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(800, 6)) * np.exp(rnd.normal(size=(800, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    graphs = graph_ann.index(df, shard_rows=60)
    shards = graph_ann.Shards(graphs.orderBy("shard").toArrow())
    q = rnd.normal(size=(50, 6))
    bound = shards.bound(q)
    for k, row in enumerate(graphs.orderBy("shard").collect()):
        inside = np.frombuffer(row["vectors"], np.float64).reshape(-1, 6)
        assert ((q @ inside.T).max(axis=1) <= bound[:, k]).all()
    assert sum(row["size"] for row in graphs.collect()) == 800


def test_neighbours_ties_and_odd_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(60)] + [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (None, same), (120, [0.5, 0.0, 0.0])]
    out = graph_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 40: [0, 1, 2, 3, 4], 120: [0, 1, 2, 3, 4]}
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert graph_ann.search(none, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert graph_ann.search(one, F.col("vec_id") % 20 == 0).count() == 0


def test_pivots_are_drawn_without_a_shuffle(spark):
    nodes = spark.range(20_000).select(F.lit(0).alias("band"), F.xxhash64("id").alias("node"), F.array(F.col("id").cast("double")).alias("v"))
    drawn = graph_ann._drawn(nodes, {0: 20_000}, {0: 50})
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert 50 <= drawn.count() < 150


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near copies", "pii", "packing"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, d)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert 0 < kept.count() <= docs.count()
        docs = kept
    packed = corpus_pipeline.run(spark, d)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_long_lists_and_deep_elements():
    block = "<h2>Fixed words of the host</h2>"
    page = lambda k, first="": wrapper.parse(f"<body>{first}" + "".join(f"<p>{k} text {i}</p>{block if i % 300 == 299 else ''}" for i in range(1500)) + "</body>")
    found = wrapper.match(page(1), page(2, "<div>new</div>"))
    assert len(found) == 1 + 1 + 1505 and sum(y.tag == "h2" for _, y in found) == 5
    assert len(wrapper.match(page(2, "<div>new</div>"), page(3, "<ul><li>a</ul><hr>"))) == 1 + 1 + 1505
    nested = [wrapper.parse("<div><p>a</p>" * 190 + tail) for tail in ("<ul>x</ul><b>y</b>", "<b>y</b>")]
    assert len(wrapper.match(*nested)) == 1 + 2 * 190 + 1
    deep = "<div><article><p>one</p>" + "<div>" * 250 + "deep" + "</div>" * 250 + "<p>last</p></article></div><p>outside</p>"
    assert wrapper.main_text(wrapper.parse(deep)) == "one\ndeep\nlast"


def test_matching_in_parts_is_the_largest(monkeypatch):
    import random

    def plain(a, b):
        if a.tag != b.tag:
            return 0
        p, q = a.kids, b.kids
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, s in enumerate(p):
            for j, t in enumerate(q):
                best[i + 1][j + 1] = max(best[i + 1][j], best[i][j + 1], best[i][j] + plain(s, t))
        return 1 + best[-1][-1]

    rnd = random.Random(5)

    def tree(depth):
        node = wrapper.Node(rnd.choice("ab") if depth < 3 else "r")
        for _ in range(rnd.randrange(12 if depth == 3 else 4) if depth else 0):
            node.add(tree(depth - 1))
        return node

    for cells in (1, 20, wrapper.CELLS):
        monkeypatch.setattr(wrapper, "CELLS", cells)
        for _ in range(60):
            a, b = tree(3), tree(3)
            assert len(wrapper.match(a, b)) == plain(a, b)


@pytest.mark.parametrize("group", [2, 128])
def test_wrapper_learns_from_all_pages(spark, monkeypatch, group):
    monkeypatch.setattr(wrapper, "GROUP", group)
    monkeypatch.setattr(wrapper, "FAN", 2)
    first = "<body><article><h1>Title {k}</h1><p>Body {k}</p><div>Subscribe now</div></article></body>"
    second = "<body><article><h1>Title {k}</h1><table><tr><td>Second layout</td></tr></table><p>Body {k}</p></article></body>"
    rows = [(k, "http://h.example/a", second.format(k=0)) for k in range(40)]  # copies
    rows += [(100 + k, "http://h.example/b", first.format(k=k)) for k in range(1, 15)] + [(200 + k, "http://h.example/c", second.format(k=100 + k)) for k in range(5)]
    rows += [(300 + k, f"http://c{k}.example/", first.format(k=j)) for k in range(20) for j in (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 3)]
    out = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows) and all(len(r["text"].split("\n")) == 2 and r["text"].startswith("Title") for r in out)


def test_pipeline_stages_on_awkward_rows(spark, awkward, nothing):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns pass every stage; an empty table gives an empty one."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    rows = awkward.withColumns({"n_chars": F.char_length("text").cast("long"), "score": F.lit("old"), "ids": F.lit(1), "component_id": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, d)
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= {1, 2, 3, 4, 5, 6, 7, 8, 9, None}, name
        if name not in ("packing",):
            assert out.columns == list(corpus_pipeline.COLUMNS), name
        if name in ("pii", "packing"):
            assert ids == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}, name
        if name == "near copies":
            assert ids == {1, 3, 4, 5, 6, 7, 8, 9, None}, name
        assert stage(spark, nothing.withColumn("n_chars", F.lit(1).cast("long")), d).count() == 0, name


def test_a_repeated_id_with_one_copied_text(spark):
    import corpus_pipeline

    words = lambda k: " ".join(f"w{k}{i}" for i in range(30))
    rows = [(1, words("a"), "en", "s", 1), (2, words("a"), "en", "s", 1), (2, words("b"), "en", "s", 1), (3, words("b"), "en", "s", 1), (4, words("a"), "en", "s", 1)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 2]
