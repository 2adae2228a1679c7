"""Operators on small tables."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marktlens.operators import brands, history, matching, matrix, scans, store
from marktlens.functions import text as names

PRODUCTS = "id string, name string, brand string, product_name string, size string, active boolean"
LISTINGS = "id string, provider_id string, name string, product_id string, brand_id string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def listings(spark, data):
    return spark.createDataFrame(data, LISTINGS)


def products(spark, data):
    return spark.createDataFrame([(i, n, b, n, "", a) for i, n, b, a in data], PRODUCTS)


def test_matrix_against_dictionaries(spark):
    """Random listings and prices: latest price, least per cell, rows of two providers or more, column order, lines, places."""
    rng = random.Random(21)
    shops = {f"s{i}": f"{rng.choice('qrstuv')}{i}.test" for i in range(6)}
    goods = {f"g{i}": f"{rng.choice(['Lamp', 'rug', 'Vase'])} {i}" for i in range(25)}
    ls = [(f"l{i}", rng.choice(list(shops)), "n", rng.choice([*goods, None, "", "gone"]), "") for i in range(120)]
    seen = [(f"l{rng.randint(0, 130)}", n, rng.randint(2, 4000) / 4, rng.randint(1, 9)) for n in range(400)]
    last, cell = {}, {}
    for pp, n, price, at in sorted(seen, key=lambda x: (x[3], x[1])):
        last[pp] = price
    for i, shop, _, good, _ in ls:
        if good in goods and i in last:
            cell[good, shop] = min(cell.get((good, shop), 1e9), last[i])
    kept = {g: {s: v for (x, s), v in cell.items() if x == g} for g in goods}
    kept = {g: v for g, v in kept.items() if len(v) >= 2}
    order = sorted(shops, key=lambda s: (-sum(s in v for v in kept.values()), shops[s]))
    ps = products(spark, [(g, n, "", rng.random() < 0.5) for g, n in goods.items()])
    latest = matrix.latest_prices(spark.createDataFrame(seen, "provider_product_id string, id long, price double, created long"))
    assert dict(rows(latest, "provider_product_id", "price")) == last
    found = matrix.cells(ps, listings(spark, ls), latest)
    assert {(r.product_id, r.provider_id): r.price for r in found.collect()} == cell
    rows_ = matrix.rows(ps, found)
    assert {r.product_id: r.prices for r in rows_.collect()} == kept
    columns = matrix.columns(spark.createDataFrame(list(shops.items()), "id string, domain string"), rows_)
    assert [r.provider_id for r in columns.orderBy("position").collect()] == order
    show = lambda v: "" if v is None else f"{v:.10f}".rstrip("0").rstrip(".")
    assert {r.line for r in matrix.csv_lines(rows_, columns).collect()} == {",".join([goods[g], *(show(v.get(s)) for s in order)]) for g, v in kept.items()}
    places = {(r.product_id, r.provider_id): r.place for r in matrix.cheapest(found).collect()}
    assert places == {(g, s): 1 + sum(w < v for (x, _), w in cell.items() if x == g) for (g, s), v in cell.items()}


def test_wide_lines(spark):
    """Lines of 30,000 columns, of which few have prices: at the ends, in the middle, at an unknown provider, null; quoted names."""
    wide, n = 30_000, 2000
    order = spark.range(1, wide + 1).select(F.concat(F.lit("s"), "id").alias("provider_id"), F.col("id").cast("int").alias("position"))
    at = lambda i: {1: 5.0, wide: 1.5, 2 + i: None, **{100 * k + i: k / 4 for k in range(30, 50)}}
    few = [("a", 'x "y"', {"gone": 1.0, "s3": 2.0}), ("b", "plain", {"gone": 1.0}), ("c", "last", {f"s{wide}": 7.25})]
    kept = spark.createDataFrame([(f"g{i}", f"g {i}", {f"s{k}": v for k, v in at(i).items()}) for i in range(n)] + few, "product_id string, name string, prices map<string,double>")
    began = time.perf_counter()
    got = matrix.csv_lines(kept, order).select("product_id", F.md5("line").alias("line")).collect()
    assert time.perf_counter() - began < 20
    line = lambda name, cells: ",".join([name, *(cells.get(k, "") for k in range(1, wide + 1))])
    want = {f"g{i}": line(f"g {i}", {k: "" if v is None else f"{v:g}" for k, v in at(i).items()}) for i in range(n)}
    want |= {"a": line('"x ""y"""', {3: "2"}), "b": line("plain", {}), "c": line("last", {wide: "7.25"})}
    assert {r.product_id: r.line for r in got} == {k: hashlib.md5(v.encode()).hexdigest() for k, v in want.items()}


def test_history(spark):
    seen = spark.createDataFrame([("p", 1.0, "EUR", 1, 1), ("p", 1.0, "EUR", 2, 2), ("p", 2.0, "EUR", 3, 3), ("p", 2.0, None, 4, 4), ("p", 2.0, None, 5, 5), ("q", None, None, 1, 6)], "provider_product_id string, price double, currency string, created int, id int")
    assert rows(history.changes(seen), "id") == [(1,), (3,), (4,), (6,)]
    two = seen.withColumn("scrape_id", F.lit("s"))
    assert rows(history.last_per_scrape(two), "provider_product_id", "id") == [("p", 5), ("q", 6)]


def test_brands(spark):
    table = spark.createDataFrame([("b1", "Ozelle"), ("b2", "Trill Moon"), ("b3", "Trill")], "id string, name string")
    ps = products(spark, [("1", "x", "Ozelle", True), ("2", "x", " Unheard ", True)])
    ls = listings(spark, [("l1", "A", "no such word", "1", ""), ("l2", "A", "30 moon, by TRILL", None, "b3"), ("l3", "A", "grey", "", None), ("l4", "A", "Trill", "2", "b1")])
    assert rows(brands.assign(ls, ps, table), "id", "target", "via", "changed") == [("l1", "b1", "product", True), ("l2", "b2", "fuzzy", True), ("l3", None, "unmatched", False), ("l4", None, "unmatched", True)]
    coverage = names.brand_coverage(F.col("name"), F.col("brand"))
    missing = brands.missing(ls, ps, spark.createDataFrame([("B", "d")], "id string, domain string"), coverage)
    assert rows(missing, "id", "domain") == [("l1", ""), ("l4", "")]
    assert rows(brands.known_brands(table, ps), "name") == [("Ozelle",), ("Trill",), ("Trill Moon",), ("Unheard",)]
    assert rows(brands.unbranded(ls, table, ps), "id") == [("l1",), ("l3",)]
    assert brands.unbranded(ls, table.limit(0), ps.limit(0)).count() == 0


def test_covered_against_nested_loop(spark):
    rng = random.Random(1)
    words = ["a", "b", "c", "dd", "ee", "!"]
    texts = sorted({" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(60)})
    labels = sorted({" ".join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(25)})
    got = brands.covered(spark.createDataFrame([(t,) for t in texts], "name string"), spark.createDataFrame([(t,) for t in labels], "name string"))
    clean = lambda x: {w for w in x.split() if w != "!"}
    want = {(t, b) for t in texts for b in labels if (clean(b) <= clean(t) if clean(b) else not clean(t))}
    assert {tuple(r) for r in got.select("name", "brand").collect()} == want


def test_proposals(spark):
    table = spark.createDataFrame([("b1", "Quil")], "id string, name string")
    ps = products(spark, [("1", "Quil Amber 40 ml", "Quil", True)])
    ls = listings(spark, [("1", "A", "has one", "1", ""), ("2", "A", "Quil Amber 40ml", "", ""), ("3", "A", "QUIL Basil 75", None, ""), ("4", "A", "basil quil 75 ML", None, ""), ("5", "A", "40 ml", None, ""), ("6", "A", "Green Tea  ", None, "")])
    got = brands.proposals(ls, ps, table)
    assert rows(got, "provider_product_id", "brand", "product_name", "size", "name") == [("3", "Quil", "Basil", "75 ml", "Quil Basil 75 ml"), ("6", "", "Green Tea", "", "Green Tea")]


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(2)
    words = ["amber", "basil", "cedar", "mist", "340", "gr", "ö", "k", "öre", "fig"]
    left, right = (sorted({"".join(sorted(rng.choices(words, k=rng.randint(0, 4)))) for _ in range(80)}) for _ in range(2))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "c string")
    got = {(r.a, r.b): r.score for r in matching.similar_names(frame(left), frame(right)).collect()}
    pairs = frame(left).select(F.col("c").alias("a")).crossJoin(frame(right).select(F.col("c").alias("b")))
    want = {(r.a, r.b): r.s for r in pairs.withColumn("s", names.dice(F.col("a"), F.col("b"))).where("s >= 0.6").collect()}
    assert got == pytest.approx(want) and len(want) > 20


@pytest.mark.parametrize("dense,block", [(0, 1), (10**9, 2048), (10**9, 7)])
def test_similar_names_either_way(spark, dense, block):
    """By the index and by blocks: the same pairs and scores, names of no, one and repeated bigrams, letters of two bytes and nulls among them."""
    rng = random.Random(8)
    letters = ["ab", "aa", "ö", "bc", "1", "ab", "aaaa"]
    left, right = (sorted({"".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(70)} | {"", "x", "öö"}) + [None] for _ in range(2))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "c string")
    got = [(r.a, r.b, r.score) for r in matching.similar_names(frame(left), frame(right), dense=dense, block=block).collect()]
    pairs = frame(left).select(F.col("c").alias("a")).crossJoin(frame(right).select(F.col("c").alias("b")))
    want = {(r.a, r.b): r.s for r in pairs.withColumn("s", names.dice(F.col("a"), F.col("b"))).where("s >= 0.6").collect()}
    assert len(got) == len(want) > 100 and {(a, b): s for a, b, s in got} == want


def test_matches_by_name_equal_greedy(spark):
    """Many listings and products of one name, ties, stored pairs above, at and below the threshold, inactive and unknown ones."""
    rng = random.Random(12)
    label = lambda: " ".join(rng.choices(["oak", "oaks", "elm", "elms", "fir"], k=2))
    goods = [(f"p{i:02d}", label(), "", i % 6 != 5) for i in range(40)]
    ls = [(f"l{i:02d}", rng.choice("AB"), label() if i else None, None, None) for i in range(45)]
    kept = {(rng.choice(ls)[0], rng.choice(goods)[0]): rng.choice([0.2, 0.6, 0.8, 1.0]) for _ in range(60)} | {("l00", "p01"): 0.9, ("gone", "p01"): 1.0, ("l03", "gone"): 0.7}
    stored = spark.createDataFrame([("m", *k, v, "s") for k, v in kept.items()], "id string, provider_product_id string, product_id string, score double, status string")
    ps, frame = products(spark, goods), listings(spark, ls)
    new = matching.candidates(frame, ps, stored)
    every = [tuple(r) for r in matching.with_provider(new.unionByName(scans.above_threshold(stored)), frame).collect()]
    found = matching.Matches(frame, ps, stored)
    assert found.computed().first()[0] == new.count() > 200
    for most in (10**6, 1):
        got = found.winners(most)
        assert rows(got, "provider_id", "provider_product_id", "product_id") == greedily(every)
        scores = {(b, c): s for _, b, c, s in every}
        assert all(r.score == scores[r.provider_product_id, r.product_id] for r in got.collect())


@pytest.mark.parametrize("most", [12, 60])
def test_matches_in_bands(spark, monkeypatch, most):
    """No provider gets more pairs of names at a time than it may, nor any of listings that have their product; the winners are those among all edges."""
    rng = random.Random(33)
    label = lambda: " ".join(rng.choices(["oak", "oaks", "elm", "elms", "fir", "firs", "ash", "yew"], k=3))
    goods = [(f"p{i:02d}", label(), "", i % 6 != 5) for i in range(50)]
    ls = [(f"l{i:02d}", rng.choice(["A", "B", None]), label() if i else None, None, None) for i in range(60)]
    kept = {(rng.choice(ls)[0], rng.choice(goods)[0]): rng.choice([0.2, 0.6, 0.7, 0.8, 0.93, 1.0]) for _ in range(50)} | {("gone", "p01"): 1.0, ("l03", "gone"): 0.7}
    stored = spark.createDataFrame([("m", *k, v, "s") for k, v in kept.items()], "id string, provider_product_id string, product_id string, score double, status string")
    ps, frame = products(spark, goods), listings(spark, ls)
    given, plain, handed = [], matching.Matches.band, set()

    def band(self, free, stored_edges, won, of, big):
        pairs = free.select("provider_id", "ia").distinct().join(self.pairs.where(of(matching.step("score"))), "ia")
        given.append({r.provider_id: r["count"] for r in pairs.groupBy("provider_id").count().collect()})
        given[-1] = {p: n for p, n in given[-1].items() if big is None or p not in {r[0] for r in big.collect()}}
        assert not handed & {r.provider_product_id for r in free.collect()}
        best = plain(self, free, stored_edges, won, of, big)
        handed.update(r.provider_product_id for r in best.collect())
        return best

    monkeypatch.setattr(matching.Matches, "band", band)
    new = matching.candidates(frame, ps, stored)
    every = [(r[0] or "", *r[1:]) for r in matching.with_provider(new.unionByName(scans.above_threshold(stored)), frame).collect()]
    got = {(r.provider_id or "", r.provider_product_id, r.product_id) for r in matching.Matches(frame, ps, stored).winners(most).collect()}
    assert got == set(greedily(every)) and len(got) > 20
    assert len(given) > 1 and max(max(g.values(), default=0) for g in given) <= most


def test_computed_leaves_pairs_in_place(spark):
    """Pairs of names are not dealt anew to count the edges, whatever Spark broadcasts by itself; repeated ids and stored rows count as in a join."""
    ls = listings(spark, [("l1", "A", "oak elm", None, None), ("l1", "A", "oak elm", None, None), ("l2", "B", "elm oak", None, None), ("l3", "B", "fir", None, None)])
    ps = products(spark, [("p1", "oak elm", "", True), ("p2", "oak elms", "", True), ("p2", "oak elms", "", True), ("p3", "oak elm", "", False)])
    stored = spark.createDataFrame([("m1", "l1", "p2", 0.7, "s"), ("m2", "l1", "p2", 0.9, "s"), ("m3", "l3", "p1", 0.9, "s"), ("m4", "l2", "gone", 0.9, "s")], "id string, provider_product_id string, product_id string, score double, status string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = matching.Matches(ls, ps, stored).computed()
        joined = re.findall(r"(\w+Join)\b.*\[i[ab]#", got._jdf.queryExecution().executedPlan().toString())
        assert got.first()[0] == matching.candidates(ls, ps, stored).count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert joined and set(joined) == {"BroadcastHashJoin"}


def test_edges_are_laid_out_from_lists(spark):
    """Edges of repeated names and ids, null ids among them, less the stored ones; only pairs of names with stored edges are looked at edge by edge."""
    rng = random.Random(41)
    label = lambda: " ".join(rng.choices(["oak", "oaks", "elm", "elms", "fir"], k=2))
    goods = [(None if i == 7 else f"p{i % 35:02d}", label(), "", i % 6 != 5) for i in range(40)]
    ls = [(None if i == 9 else f"l{i % 41:02d}", "A", label() if i else None, None, None) for i in range(45)]
    kept = {(rng.choice(ls)[0], rng.choice(goods)[0]) for _ in range(40)} | {("gone", "p01"), ("l03", None), (None, "p01")}
    stored = spark.createDataFrame([("m", *k, 0.5, "s") for k in [*kept, *kept]], "id string, provider_product_id string, product_id string, score double, status string")
    ps, frame = products(spark, goods), listings(spark, ls)
    a, b = frame.select("id", names.compact(F.col("name")).alias("a")), ps.where("active").select(F.col("id").alias("p"), names.compact(F.col("name")).alias("b"))
    want = [(r.id, r.p, round(r.s, 6)) for r in a.crossJoin(b).withColumn("s", names.dice(F.col("a"), F.col("b"))).where("s >= 0.6").collect()]
    found = matching.candidates(frame, ps, stored, digits=6)
    got = [tuple(r) for r in found.collect()]
    order = lambda xs: sorted(map(str, xs))
    assert order(got) == order(x for x in want if None in x[:2] or x[:2] not in kept) and len(want) > len(got) > 200 and any(None in x for x in got)
    assert order(tuple(r) for r in matching.candidates(frame, ps, digits=6).collect()) == order(want)
    plain = found._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "Generate explode" in plain and "[i" in plain and "product_id#" not in "".join(x for x in plain.splitlines() if "LeftAnti" in x)
    rows_ = spark.createDataFrame([(i % 3 // 2, str(i)) for i in range(60)] + [(0, None)], "ia long, x string")
    lists = matching.in_lists(rows_, "ia", "x", most=10).collect()
    assert sorted(map(str, ((r.ia, x) for r in lists for x in r.x))) == sorted(str(tuple(r)) for r in rows_.collect()) and len(lists) > 5


def edges(spark, data):
    return spark.createDataFrame(data, matching.EDGES)


def greedily(data):
    """Winners by a plain loop over all edges, the best first."""
    taken = []
    for p, listing, product, _ in sorted(data, key=lambda e: (-e[3], e[1], e[2])):
        if all(p != q or (listing != x and product != y) for q, x, y in taken):
            taken.append((p, listing, product))
    return sorted(taken)


def test_rounds_equal_greedy(spark):
    rng = random.Random(4)
    data = [(p, f"l{rng.randint(0, 12)}", f"p{rng.randint(0, 12)}", rng.randint(6, 9) / 10) for p in "AB" for _ in range(60)]
    data = list({d[:3]: d for d in data}.values())
    every = edges(spark, data)
    want = greedily(data)
    for limit in (10**6, 1):
        assert rows(matching.assign(every, limit), "provider_id", "provider_product_id", "product_id") == want


def test_match_and_link_against_loops(spark):
    """Catalog and listings of random words: new pairs, winners, links and statuses by hand."""
    rng = random.Random(22)
    words = ["amber", "basil", "cedar", "mist", "silk", "50 ml", "75 ml", "dry"]
    say = lambda: " ".join(rng.sample(words, rng.randint(2, 4)))
    goods = [(f"p{i:02}", say(), "", i % 4 > 0) for i in range(14)]
    ls = [(f"l{i:02}", rng.choice("AB"), say(), rng.choice([None, "p01"]), "") for i in range(16)]
    compact = lambda x: "".join(sorted(x.lower().split()))

    def score(x, y):
        x, y = compact(x), compact(y)
        left = [x[i : i + 2] for i in range(len(x) - 1)]
        hits = 0
        for i in range(len(y) - 1):
            if y[i : i + 2] in left:
                left.remove(y[i : i + 2])
                hits += 1
        return 1.0 if x == y else 2 * hits / (len(x) + len(y) - 2)

    kept = [(ls[i][0], goods[i][0], rng.choice([0.3, 0.7])) for i in range(10)]
    new = {(x[0], g[0]): score(x[2], g[1]) for x in ls for g in goods if g[3] and score(x[2], g[1]) >= 0.6 and (x[0], g[0]) not in {k[:2] for k in kept}}
    stored = spark.createDataFrame([(f"m{i}", *k, "pending") for i, k in enumerate(kept)], "id string, provider_product_id string, product_id string, score double, status string")
    ps, frame = products(spark, goods), listings(spark, ls)
    got = matching.candidates(frame, ps, stored)
    assert {(r.provider_product_id, r.product_id): r.score for r in got.collect()} == pytest.approx(new) and len(new) > 5
    of = {x[0]: x[1] for x in ls}
    every = [(of[a], a, b, v) for (a, b), v in new.items()] + [(of[a], a, b, v) for a, b, v in kept if v >= 0.6]
    want = {a: b for _, a, b in greedily([(p, a, b, round(v, 9)) for p, a, b, v in every])}
    winners = matching.assign(matching.with_provider(got.unionByName(scans.above_threshold(stored)).withColumn("score", F.round("score", 9)), frame))
    assert {r.provider_product_id: r.product_id for r in winners.collect()} == want
    assert {r.id: r.product_id for r in matching.linked(frame, winners).collect()} == {x[0]: want.get(x[0]) for x in ls}
    assert {r.id: r.status for r in matching.confirmed(stored, winners).collect()} == {f"m{i}": "confirmed" if want.get(a) == b else "pending" for i, (a, b, _) in enumerate(kept)}
    assert tuple(matching.match_summary(got, stored, frame, winners).first()) == (len(new), len(kept), len(ls), len(want))


def test_scans(spark):
    ps = products(spark, [("1", "a", "", True), ("2", "b", "", False)])
    ls = listings(spark, [("l1", "A", "x", "1", ""), ("l2", "B", "y", "", "")])
    matches = spark.createDataFrame([("m1", "l1", "1", 0.6, "p"), ("m2", "l9", "1", 0.5, "p")], "id string, provider_product_id string, product_id string, score double, status string")
    assert rows(scans.active_products(ps), "id") == [("1",)] and rows(scans.of_provider(ls, "B"), "id") == [("l2",)]
    assert rows(scans.above_threshold(matches), "score") == [(0.6,)] and rows(scans.stored_for(matches, ls), "id") == [("m1",)]
    assert rows(scans.related_ids(matches, "l9"), "id") == [("m2",)]


def test_store(spark):
    ls = listings(spark, [("l1", "A", "x", "1", "")])
    seen = spark.createDataFrame([("A", "x", "/new", 2), ("A", "x", "/old", 1), ("B", "x", "/b", 1)], "provider_id string, name string, url string, seen_at int")
    got = store.upsert_listings(ls, seen)
    assert [(r.provider_id, r.url, r.is_new) for r in got.orderBy("provider_id").collect()] == [("A", "/old", False), ("B", "/b", True)]
    images = spark.createDataFrame([("l1", "a", 0, True), ("l1", "b", 1, False), ("l2", "z", 0, True)], "provider_product_id string, url string, position long, is_primary boolean")
    cards = spark.createDataFrame([("l1", ["b", "c", "b"])], "provider_product_id string, images array<string>")
    assert rows(store.sync_images(images, cards), "url", "position", "is_primary", "action") == [("a", 0, True, "delete"), ("b", 0, True, "update"), ("c", 1, False, "insert")]
    left = store.cascade_delete({"provider_products": ls, "provider_product_images": images}, spark.createDataFrame([("l1",)], "id string"))
    assert left["provider_products"].count() == 0 and rows(left["provider_product_images"], "url") == [("z",)]
    providers = spark.createDataFrame([("1", "a.com", "a", True, None)], "id string, domain string, name string, enabled boolean, default_currency string")
    hosts = spark.createDataFrame([("a.com",), ("b.com",), ("b.com",), ("",)], "host string")
    assert rows(store.ensure_providers(providers, hosts), "domain") == [("a.com",), ("b.com",)]


def test_delta(spark):
    schema = "name string, price_text string, price double, url string, images array<string>, currency string"
    cards = spark.createDataFrame([("a", "1", 1.0, None, ["x", "y"], None), ("a", "1", 1.0, None, ["y", "x"], None), ("a", "1", 1.0, "u", ["x"], None)], schema)
    assert store.delta(cards).count() == 2
    assert store.delta(cards, seen=cards.limit(1)).count() == 1
    polls = spark.createDataFrame([("u", 1, ["a"]), ("u", 2, ["a", "b"]), ("u", 3, ["c", "d"])], "url string, captured_at long, products array<string>")
    assert store.best_grid(polls).first().products == ["a", "b"]


def test_price_history_of_ingest(spark):
    """Against a loop: per listing only changes are stored, the last of a scrape counts, and a repeated batch adds nothing."""
    from marktlens.operators.ingest import insert_prices
    from marktlens.schemas import TABLES

    rng = random.Random(41)
    prices, want, last = spark.createDataFrame([], TABLES["provider_product_prices"]), set(), {}
    for scrape in range(4):
        seen = [(f"{scrape}-{n:03}", f"l{rng.randint(0, 5)}", f"s{scrape}", float(rng.randint(1, 2)), rng.choice(["", "EUR"]), "t", scrape) for n in range(12)]
        now = {}
        for row in seen:
            now[row[1]] = row
        for listing, row in now.items():
            if last.get(listing) != row[3:5]:
                last[listing] = row[3:5]
                want.add(row[0])
        batch = spark.createDataFrame(seen, "id string, provider_product_id string, scrape_id string, price double, currency string, price_text string, at long").withColumn("created", F.timestamp_seconds("at")).drop("at")
        twice = insert_prices(insert_prices(prices, batch), batch)
        prices = spark.createDataFrame(twice.collect(), TABLES["provider_product_prices"])
    assert {r.id for r in prices.collect()} == want


def test_matches_and_stalls(spark):
    from marktlens.operators.ingest import insert_matches
    from marktlens.streaming.flows import stalls

    stored = spark.createDataFrame([("m", "l1", "p1", 0.7, "confirmed")], "id string, provider_product_id string, product_id string, score double, status string")
    got = insert_matches(stored, spark.createDataFrame([("l1", "p1", 0.9), ("l1", "p2", 0.8), ("l1", "p2", 0.8)], "provider_product_id string, product_id string, score double"))
    assert rows(got, "provider_product_id", "product_id", "score", "status") == [("l1", "p1", 0.7, "confirmed"), ("l1", "p2", 0.8, "pending")]
    polls = spark.createDataFrame([("u", at, n) for at, n in enumerate([2, 5, 5, 4, 5, 6, 6])], "url string, captured_at long, n_products long")
    assert [(r.n_stalled, r.stopped) for r in stalls(polls).orderBy("captured_at").collect()] == [(0, False), (0, False), (1, False), (2, False), (3, True), (0, False), (1, False)]
