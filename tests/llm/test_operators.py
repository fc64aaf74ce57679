import random
import re

import pytest
from pyspark.sql import functions as F

from kinmatch.llm import balanced_splits, grid_components, leakage, listing_groups, lookalikes, packing, refined_duplicates, truncation
from kinmatch.llm.title_fields import fields, number
from tests.conftest import rows

LONG = "kopi bubuk " * 20_000


def clash(df):
    """Further columns whose names meet those used inside the operators."""
    for c in ("id", "text", "t", "h", "k", "c", "n", "key", "look", "folded", "node", "root", "src", "dst", "unit", "block", "bin", "load", "box", "item", "rank", "row_id"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


# ---- 1


def test_lookalikes_keep_visible_differences(spark):
    data = [
        ("a", "Kopi Susu"), ("b", "Kopi Susu"), ("c", "Ko​pi Susu"), ("d", "Коpi Susu"), ("e", "Ｋｏｐｉ　Ｓｕｓｕ"),
        ("f", "kopi susu"), ("g", "Kopi  Susu"), ("h", "Kopi\tSusu"), ("i", "Kopi-Susu"), ("j", None), (None, "Kopi Susu"),
        ("k", "Cà phê"), ("l", "Cà phê"), ("m", "Ca phe"), ("n", "m²"), ("o", "m2"), ("p", ""), ("q", ""), ("a", "Kopi Susu"),
    ]
    df = clash(spark.createDataFrame(data, "posting_id string, title string"))
    got = set(rows(lookalikes.lookalike_pairs(df, "posting_id", "title")))
    group = "abcde"
    assert got == {(x, y) for x in group for y in group if x < y} | {("k", "l")}


def test_lookalike_pairs_equal_brute_force(spark, monkeypatch):
    r = random.Random(1)
    swap = {"a": "а", "o": "ο", "i": "і", " ": " "}
    data = []
    for i in range(80):
        t = f"{r.choice(['Mug', 'mug'])} keramik {r.randrange(6)}"
        data.append((f"p{i:02d}", "".join(swap[c] if c in swap and r.random() < 0.2 else c for c in t)))
    plain = {v: k for k, v in swap.items()}
    look = {p: "".join(plain.get(c, c) for c in t) for p, t in data}
    text = dict(data)
    want = {(x, y) for x in text for y in text if x < y and text[x] != text[y] and look[x] == look[y]}
    df = spark.createDataFrame(data, "p string, t string")
    assert set(rows(lookalikes.lookalike_pairs(df, "p", "t"))) == want
    monkeypatch.setattr(lookalikes, "PART_ROWS", 3)
    assert set(rows(lookalikes.lookalike_pairs(df, "p", "t"))) == want
    links = {r["id"]: r["links"] for r in lookalikes.lookalike_classes(df, "p", "t").collect()}
    assert links == {x: n for x in text if (n := sum(x in pair for pair in want))}


def test_consistent_text_folds_after_replacing(spark):
    df = spark.createDataFrame([("ＳＴＲＡßE",), ("ᎪВc",), (None,), ("",), ("ab",), (LONG,)], "title string")
    got = [r["f"] for r in lookalikes.consistent_text(df, "title", "f").collect()]
    assert got == ["strasse", "abc", None, "", "ab", LONG]
    assert lookalikes.consistent_text(df.limit(0), "title", "f").count() == 0 and lookalikes.lookalike_pairs(df.limit(0).withColumn("i", F.lit("a")), "i", "title").count() == 0


# ---- 2


@pytest.mark.parametrize("cell_edges", [3, 40, 10_000])
def test_grid_components_equal_union_find(spark, cell_edges):
    r = random.Random(cell_edges)
    edges = [(f"v{r.randrange(150):03d}", f"v{r.randrange(150):03d}") for _ in range(110)] + [("v000", f"v{i:03d}") for i in range(60, 90)]
    edges += [(b, a) for a, b in edges[:10]] + [("x1", None), (None, "x2"), ("x3", "x3"), (None, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = clash(spark.createDataFrame(edges, "l string, r string"))
    got = dict(rows(grid_components.grid_components(df, "l", "r", cell_edges=cell_edges)))
    assert got == {v: find(v) for v in parent}


def test_long_chain_and_empty_links(spark):
    chain = spark.createDataFrame([(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)], "src string, dst string")
    got = grid_components.grid_components(chain, cell_edges=20)
    assert got.select("root").distinct().count() == 1 and got.count() == 301
    none = grid_components.grid_components(chain.limit(0))
    assert none.count() == 0
    every = grid_components.assign_groups(none, spark.createDataFrame([("a",), ("a",), (None,)], "posting_id string"))
    assert [(r["posting_id"], r["cluster_size"]) for r in every.collect()] == [("a", 1)]


def test_chain_in_id_order_takes_few_rounds(spark):
    import math

    from kinmatch.runtime import Scratch

    n = 1_000_000
    ids = F.format_string("c%07d", F.col("id"))
    chain = spark.range(n).select(ids.alias("src"), F.format_string("c%07d", F.col("id") + 1).alias("dst"))
    scratch = Scratch(spark, "chain")
    maps = grid_components.contracted(scratch.write(chain), scratch, 40_000)
    assert 1 < len(maps) <= 2 * math.log2(n)


def test_heavy_cells_are_split(spark):
    hub = spark.range(6_000).select(F.lit("hub").alias("src"), F.concat(F.lit("v"), "id").alias("dst"))
    pairs = spark.range(12_000).select(F.concat(F.lit("x"), "id").alias("src"), F.concat(F.lit("y"), "id").alias("dst"))
    links = hub.unionByName(pairs)
    side = 19  # as for cells of 100
    cells = grid_components.cells_of(links, side, 0, 100).groupBy("row_", "col_", "salt").count()
    assert cells.agg(F.max("count")).first()[0] <= 200
    got = grid_components.grid_components(links, cell_edges=100)
    assert got.where("root = 'hub'").count() == 6_001 and got.count() == 30_001


# ---- 3


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("mug keramik, hitam, Jargano Dupuwozas M-275, 180 ml", ("mug", "180ml", "black", 1, "m275", "jargano dupuwozas")),
        ("Ly Sứ / Jargano Dupu-wozas / Đen 180 Mililiter Chính Hãng 100%", ("mug", "180ml", "black", 1, "", "jargano dupuwozas")),
        ("POWER BANK FENDEX MAPUNELEN K295 20.000 MAH BIRU DONGKER ORIGINAL 100%", ("powerbank", "20000mah", "navy", 1, "k295", "fendex mapunelen")),
        ("giày chạy bộ 3 cái Pelquo Mekogivun no. 38 hồng", ("shoes", "size 38", "pink", 3, "", "pelquo mekogivun")),
        ("body lotion Verfia Hehawevu M 226 2-pack original 100 ML", ("lotion", "100ml", "original", 2, "m226", "verfia hehawevu")),
        ("sữa dưỡng thể | Kelnimo Fikivadex x251 | 0,2L | hoa hồng", ("lotion", "200ml", "rose", 1, "x251", "kelnimo fikivadex")),
        ("", ("", "", "", 1, "", "")),
    ],
)
def test_title_fields(title, want):
    assert fields(title) == want


def test_numbers_by_unit():
    assert [number(*x) for x in (("20.000", "mah"), ("1,7", "m"), ("0.125", "l"), ("2.500", "ml"), ("0.5", "kg"))] == [20000, 1.7, 0.125, 2500, 0.5]


def test_names_align_softly():
    same, other = listing_groups.same_name, listing_groups.typing_distance
    assert same("jargano dupuwozas", "dupuwozas") and same("jargano pura hugin", "purahugin") and same("brantove pissiripux", "brantove pisiripux")
    assert same("fukadeka", "pelrast fukadea")
    assert not same("jargano dupuwozas", "jargano zolimagis") and not same("", "x") and not same("dupuwozas", "kelmoss rikehosex")
    assert other("abcd", "abdc", 2) == 1 and other("abc", "xyz", 1) == 2


def test_product_groups(spark):
    data = [
        ("a", "mug keramik hitam Jargano Dupuwozas M275 180 ml promo murah"), ("b", "180ML black coffee mug JARGANO DUPUWOZAS"), ("c", "ly sứ đen Dupwuozas 0,18 l"),
        ("d", "mug keramik hitam Jargano Dupuwozas 350 ml"), ("e", "mug keramik putih Jargano Dupuwozas 180 ml"), ("f", "mug keramik hitam Jargano Dupuwozas 180 ml isi 3"),
        ("g", "mug keramik hitam Jargano Zolimagis 180 ml"), ("h", None), (None, "mug"), ("i", ""), ("j", "???"), ("k", "???"), ("a", "mug keramik hitam Jargano Dupuwozas M275 180 ml promo murah"),
    ]
    df = clash(spark.createDataFrame(data, "posting_id string, title string"))
    g = {r["posting_id"]: r["group_id"] for r in listing_groups.product_groups(df).collect()}
    assert g["a"] == g["b"] == g["c"] and len({g[x] for x in "adefg"}) == 5 and g["j"] == g["k"] and "h" not in g
    pairs = set(rows(listing_groups.group_pairs(listing_groups.product_groups(df))))
    assert pairs == {("a", "b"), ("a", "c"), ("b", "c"), ("j", "k")}
    assert listing_groups.product_groups(df.limit(0)).count() == 0


def test_products_off_the_lists(spark):
    data = [
        ("a", "Sandisk flashdisk 32GB"), ("b", "Sandisk flashdisk 64GB"), ("c", "Dell monitor 24 inch"), ("d", "Dell monitor 27 inch"), ("e", "Samsung Galaxy A12 128GB 6GB"),
        ("f", "Samsung Galaxy A12 64GB 4GB"), ("g", "logitech wireless mouse"), ("h", "mouse wireless logitech"), ("i", "Flashdisk Sandisk 32 GB promo"), ("j", "galaxy samsung a12 6gb 128gb"),
    ]
    df = spark.createDataFrame(data, "posting_id string, title string")
    groups = listing_groups.product_groups(df)
    assert set(rows(listing_groups.group_pairs(groups))) == {("a", "i"), ("e", "j"), ("g", "h")}
    assert {r["posting_id"]: r["links"] for r in listing_groups.product_classes(groups).collect()} == {x: int(x in "aiejgh") for x, _ in data}


def test_pivots_are_the_same_in_one_task_and_in_rounds(spark, monkeypatch):
    from kinmatch.runtime import Scratch

    r = random.Random(12)
    links = {tuple(sorted(r.sample(range(1, 90), 2))) for _ in range(160)}
    nodes = spark.createDataFrame([(i, r.randrange(1, 4)) for i in range(1, 90)], "sid long, support long")
    df = spark.createDataFrame(sorted(links), "a long, b long")
    one = rows(listing_groups.pivot_clusters(nodes, df, Scratch(spark, "one")))
    monkeypatch.setattr(listing_groups, "FINISH_LINKS", 0)
    assert rows(listing_groups.pivot_clusters(nodes, df, Scratch(spark, "two"))) == one
    monkeypatch.setattr(listing_groups, "PART_ROWS", 2)
    groups = spark.createDataFrame([(i % 4, f"p{i:02d}") for i in range(30)], "group_id int, posting_id string")
    assert len(rows(listing_groups.group_pairs(groups))) == sum(n * (n - 1) // 2 for n in (8, 8, 7, 7))


def test_windows_meet_across_bucket_cuts(spark):
    from kinmatch.runtime import Scratch

    nodes = spark.createDataFrame([(i, "g", "", f"name{chr(97 + i // 26)}{chr(97 + i % 26)}abcdef") for i in range(60)], "sid long, grp string, code string, name string")
    few = listing_groups.neighbour_links(nodes, Scratch(spark, "t1"), window=4, bucket_rows=7)
    one = listing_groups.neighbour_links(nodes, Scratch(spark, "t2"), window=4, bucket_rows=100_000)
    assert set(rows(few)) == set(rows(one)) and few.count() > 0


# ---- 4


def test_splits_keep_groups_whole_and_shares_near(spark):
    r = random.Random(3)
    listing = [(i, f"p{i}", f"g{int(r.paretovariate(0.8)) % 150:03d}" if i % 9 else None) for i in range(3_000)] + [(3_000, None, None)]
    comps = [("c1", ["g001", "g002"]), ("c1", ["g003", None]), ("c2", ["g003", "g004"]), ("c3", None), (None, ["g005", "g006"]), ("c4", []), ("c5", ["zz"]), ("c2", ["g003", "g004"])]
    ls = clash(spark.createDataFrame(listing, "row_number int, posting_id string, label_group string"))
    cs = spark.createDataFrame(comps, "component_id string, label_groups array<string>")
    held = dict(rows(balanced_splits.held_together(cs).select("label_group", "first_label_group")))
    assert held == {"g001": "g001", "g002": "g001", "g003": "g001", "g004": "g001", "zz": "zz"}
    out = balanced_splits.split_rows(ls, cs, id_col="posting_id").collect()
    assert len(out) == len(listing)
    by = {}
    for x in out:
        key = held.get(x["label_group"], x["label_group"])
        if key:
            by.setdefault(key, set()).add(x["split"])
    assert all(len(v) == 1 for v in by.values())
    share = {s: sum(x["split"] == s for x in out) / len(out) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.05 and share["validation"] > 0.05 and share["test"] > 0.05
    assert balanced_splits.split_rows(ls.limit(0), cs, id_col="posting_id").count() == 0
    assert balanced_splits.held_together(cs.limit(0)).count() == 0


def test_differencing_balances_over_blocks(spark):
    r = random.Random(8)
    units = spark.createDataFrame([(f"u{i}", r.randrange(1, 40)) for i in range(900)], "unit string, weight long")
    out = balanced_splits.balance_units(units, bins=10, block_units=40)
    loads = [x["w"] for x in out.join(units, "unit").groupBy("bin").agg(F.sum("weight").alias("w")).collect()]
    assert len(loads) == 10 and max(loads) - min(loads) <= 40 and out.count() == 900
    again = balanced_splits.balance_units(units.repartition(7), bins=10, block_units=40)
    assert rows(out) == rows(again)


# ---- 5


def test_refined_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    data = []
    for i in range(200):
        words = [r.choice(["Kopi", "kopi", "MUG", "mug", "đen", "ĐEN", "5", "X9"]) for _ in range(r.randrange(0, 4))]
        h = r.choice(["ab12", "AB-12", "ab 1:2", "cd34"])
        data.append((i, r.choice([" ", ", ", "-", "  "]).join(words) + r.choice(["", "!", " "]), h if i % 17 else None))
    data += [(900, None, "ab12"), (901, "", ""), (902, "!!", "--"), (903, LONG, "q"), (904, LONG.upper(), "Q")]
    df = clash(spark.createDataFrame(data, "row_number int, title string, image_phash string"))

    def key(t, h):
        return tuple(sorted(w for w in re.split(r"[\W_]+", t.lower()) if w)), re.sub(r"[\W_]+", "", h.lower())

    groups = {}
    for i, t, h in data:
        if t is not None and h is not None:
            groups.setdefault(key(t, h), []).append(i)
    want = sorted((i, min(g), len(g)) for g in groups.values() for i in g)
    assert rows(refined_duplicates.refine_duplicates(df, "row_number", "title", "image_phash").select("row_id", "first_id", "copies")) == want
    assert refined_duplicates.distinct_records(df, "row_number", "title", "image_phash").count() == len(groups)
    assert refined_duplicates.refine_duplicates(df.limit(0), "row_number", "title", "image_phash").count() == 0


# ---- 6


def test_packing_is_whole_and_tight(spark):
    r = random.Random(6)
    sizes = {i: min(3_000, int(r.paretovariate(0.9) * 40)) for i in range(3_000)} | {5_000: 0, 5_001: 1024, 5_002: 2048, 5_003: 1023}
    df = spark.createDataFrame(list(sizes.items()), "id long, tokens int")
    for block in (100_000, 300):
        out = packing.pack_texts(df, block_items=block).collect()
        fill, parts = {}, {}
        for x in out:
            fill[x["container_id"]] = fill.get(x["container_id"], 0) + x["tokens"]
            parts.setdefault(x["id"], []).append((x["piece"], x["first_token"], x["tokens"]))
        assert max(fill.values()) <= 1024 and set(parts) == set(sizes)
        for i, ps in parts.items():
            assert sum(p[2] for p in ps) == max(1, sizes[i]) and (len(ps) == 1) == (sizes[i] <= 1024)
            assert [p[1] for p in sorted(ps)] == [1024 * k for k in range(len(ps))]
        assert sum(fill.values()) / (1024 * len(fill)) > 0.97
    equal = spark.createDataFrame([(i % 9, 300) for i in range(900)], "id long, tokens int")
    one, two = (packing.pack_texts(x, block_items=100) for x in (equal, equal.repartition(7)))
    assert rows(one) == rows(two) and one.count() == 900
    assert packing.pack_texts(df.limit(0)).count() == 0


def test_sum_of_squares_equals_its_definition():
    r = random.Random(7)
    sizes, capacity = [r.randrange(1, 12) for _ in range(200)], 12
    where, fills = packing.sum_of_squares(sizes, capacity)
    levels, seen = {}, []
    for s, c in zip(sizes, where, strict=True):
        def cost(h):
            trial = dict(levels)
            if h:
                trial[h] -= 1
            if h + s < capacity:
                trial[h + s] = trial.get(h + s, 0) + 1
            return sum(v * v for v in trial.values())

        best = min(cost(h) for h in [0, *[h for h, v in levels.items() if v and h + s <= capacity]])
        had = seen[c] if c < len(seen) else 0
        assert cost(had) == best
        if had:
            levels[had] -= 1
        else:
            seen.append(0)
        seen[c] = had + s
        if seen[c] < capacity:
            levels[seen[c]] = levels.get(seen[c], 0) + 1
    assert seen == fills


def test_token_counts(spark):
    df = clash(spark.createDataFrame([(1, "kopi bubuk 250 gr"), (2, None), (None, "x"), (3, ""), (4, LONG)], "doc_id long, txt string"))
    got = dict(rows(packing.token_counts(df, "doc_id", "txt")))
    encode = packing.tokenizer(packing.TOKENIZER).encode_ordinary
    assert got == {1: len(encode("kopi bubuk 250 gr")), 3: 0, 4: len(encode(LONG))}


# ---- 7

ITEM = "Question AB-12345: does Fenifuvi R502 by Jardex equal the white sneakers called Mapugeme? Buyers of Kiwupada rejected Herozahu since the GX-30788 seal said 9 watt. Given title Zowovitan QY-75753, name the purple variant that Nusovimex sold."


def _texts():
    others = [
        "Question CD-11111: does Rovitami T109 by Kelmoss equal the black towel called Zidaremo? Buyers of Walofiti rejected Nemisuda since the HK-20202 seal said 5 ml. Given title Pufosalo TT-31313, name the red variant that Gemaniro sold.",
        "Question EF-22222: does Masolidu V770 by Ostdex equal the green shampoo called Bikarone? Buyers of Tolupeza rejected Sadivoke since the LM-40404 seal said 3 cm. Given title Voranike UU-51515, name the pink variant that Hisotala sold.",
    ]
    return ITEM, others


def test_verbatim_and_rewritten_leaks(spark):
    item, others = _texts()
    words = leakage.words_of(item)
    items = clash(spark.createDataFrame([(1, item), (2, others[0]), (3, others[1]), (4, "too short"), (5, None), (6, "")], "item_id long, text string"))
    other_parameters = item.replace("Fenifuvi", "Bezokara").replace("AB-12345", "ZZ-77777").replace("9 watt", "7 watt")
    broken = other_parameters.replace("Herozahu", "Bezokara")
    docs = [
        (10, "intro " + " ".join(words[3:15]).upper() + " outro"), (11, " - ".join(words[3:14])), (12, item.replace(" ", "\n") + item), (13, other_parameters), (14, broken),
        (15, None), (16, ""), (17, LONG + " " + " ".join(words[5:17]) + " " + LONG), (18, "The seller posted the white sneakers on Monday and everyone was happy with them."),
    ]
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    got = set(rows(leakage.verbatim_leaks(df, items)))

    def holds(text, other):
        a, b = leakage.words_of(text), leakage.words_of(other)
        runs = {tuple(b[i : i + 12]) for i in range(len(b) - 11)}
        return any(tuple(a[i : i + 12]) in runs for i in range(len(a) - 11))

    want = {(i, j) for i, t in docs if t for j, s in ((1, item), (2, others[0]), (3, others[1])) if holds(t, s)}
    assert got == want and {(10, 1), (12, 1), (17, 1)} <= got and (11, 1) not in got
    again = {(r["doc_id"], r["item_id"]) for r in leakage.rewritten_leaks(df, items).collect()}
    assert (13, 1) in again and (12, 1) not in {x for x in again if x[1] == 1}
    assert leakage.verbatim_leaks(df.limit(0), items).count() == 0 and leakage.verbatim_leaks(df, items.limit(0)).count() == 0


def test_rewritten_amounts_may_be_spelt_otherwise(spark):
    item, others = _texts()
    items = spark.createDataFrame([(1, item), (2, others[0]), (3, others[1])], "item_id long, text string")
    planted = {}
    r = random.Random(4)
    for i in range(40):
        t = item.replace("9 watt", r.choice(["7watt", "1,5 kg", "200 ml", "3.5L", "12 cm"]))
        for name in ("Fenifuvi", "Jardex", "Mapugeme", "Kiwupada", "Herozahu", "Zowovitan", "Nusovimex"):
            if r.random() < 0.6:
                t = t.replace(name, "Qo" + "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(3)) + r.choice(["", " Xylo"]))
        planted[100 + i] = "Some words before. " + t + " Some words after."
    docs = spark.createDataFrame([*planted.items(), (1, "Buyers of towels said that the seal was fine and the variant sold well in the shop on Monday morning, so name it.")], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leakage.rewritten_leaks(docs, items).collect()}
    assert len({d for d, i in got if i == 1} & set(planted)) >= 0.95 * len(planted) and not [d for d, _ in got if d == 1]


# ---- 8


def _corpus():
    r = random.Random(9)
    days, colours, closers = ["Monday", "Friday", "Sunday"], ["red", "blue", "grey"], ["Best regards", "Thanks, the shop team", "#promo #shop"]
    makers = [
        lambda: f"We will reply about the refund on {r.choice(days)}.", lambda: f"Sorry, the {r.choice(colours)} one is sold out since {r.choice(days)}.",
        lambda: f"Can you ship {r.randrange(2, 50)} boxes before {r.choice(days)}?", lambda: f"The {r.choice(colours)} lid was loose but still looks neat.",
    ]
    texts = []
    for i in range(900):
        t = " ".join(r.choice(makers)() for _ in range(r.randrange(2, 9)))
        if i % 5 == 1:
            t += " " + r.choice(closers)
        elif i % 7 == 1:
            t = t[:-1]
        texts.append((i, t, "chat" if i % 2 else "feed"))
    return texts


def test_truncation_by_spike_and_by_broken_transfer(spark):
    base = _corpus()
    cut = {i for i, t, s in base if s == "feed" and len(t) > 200}
    data = [(i, t[:200] if i in cut else t, s) for i, t, s in base]
    cut = {i for i, t, s in data if i in cut and not t.endswith((".", "?", "!"))}
    data += [(2_000, "We will reply about the ref", "chat"), (2_001, "Sorry, the red one is sold", "chat"), (2_002, "The red lid was loose &am", "chat"), (2_003, "Can you ship 7 boxes...", "chat")]
    data += [(2_010, "Can you ship 7 boxes before Friday...", "chat"), (2_011, "We will reply about the refund on Monday", "chat"), (2_012, "The blue lid was loose but still looks neat 👍", "chat"), (2_013, None, "chat"), (2_014, "  ", None), (2_015, "", "feed"), (None, "Sorry, the", "feed")]
    df = clash(spark.createDataFrame(data, "doc_id long, text string, source string"))
    got = {r["id"]: r["spike"] for r in truncation.truncated_texts(df).collect()}
    assert {2_000, 2_001, 2_002, 2_003} <= set(got) and not {2_010, 2_011, 2_012, 2_013, 2_014, 2_015} & set(got)
    assert len(cut & set(got)) >= 0.97 * len(cut) and sum(got[i] for i in cut if i in got) >= 0.97 * len(cut)
    assert len(set(got) - cut - {2_000, 2_001, 2_002, 2_003}) <= 0.01 * len(data)
    rates = {r["source"]: (r["texts"], r["truncated"]) for r in truncation.source_rates(df, truncation.truncated_texts(df)).collect()}
    assert rates[None] == (1, 0) and rates["feed"][1] >= 0.97 * len(cut)
    assert truncation.truncated_texts(df.limit(0)).count() == 0


def test_copies_of_a_text_do_not_hide_its_lost_end(spark):
    data = [*_corpus(), (2_000, "We will reply about the ref", "chat"), (2_001, "Sorry, the red one is sold", "chat"), (2_002, "Can you ship 7 boxes", "chat")]
    one = spark.createDataFrame(data, "doc_id long, text string, source string")
    many = one.crossJoin(spark.range(20)).select((F.col("doc_id") + 10_000 * F.col("id")).alias("doc_id"), "text", "source")
    found = {r["id"] for r in truncation.truncated_texts(one).collect()}
    assert {2_000, 2_001, 2_002} <= found
    got = sorted(r["id"] for r in truncation.truncated_texts(many).collect())
    assert got == sorted(i + 10_000 * k for i in found for k in range(20))


def test_ends(spark):
    some = ["to be", "a...", "x\ufffd", "ship 20.", "a [...] ", "Done.", "ok 👍", "(end of note)", "choose XS-10191.", "", " \n"]
    got = {r["t"]: (r["o"], r["b"]) for r in spark.createDataFrame([(t,) for t in some], "t string").select("t", truncation.ends_open(F.col("t")).alias("o"), truncation.bare_end(F.col("t")).alias("b")).collect()}
    assert [t for t in some if got[t][0]] == some[:5] and got["a [...] "][1] == "a" and got["Done."][1] == "Done."


def test_word_runs_equal_their_definition():
    texts = ["We pack 12 boxes. The red Mug is", "", "...", "ok\nThe Red mug holds 0.5 l!", "x"]
    last, ends, runs = truncation.word_runs(texts)
    assert [j >= 0 for j in last] == [True, False, False, True, True] and len(runs) == 2 * (truncation.ORDER - 1)
    by = {}
    for h, there in runs:
        for j in range(len(h)):
            if there[j]:
                by.setdefault(int(h[j]), []).append(j)
    # "The red Mug" and "The Red mug" meet as they are
    shared = [places for places in by.values() if len(places) > 1]
    assert shared and all(len(p) == 2 for p in shared) and ends.sum() == 5


def test_bit_filter_holds_every_key(spark):
    import numpy as np

    from kinmatch.llm.bit_filter import bit_filter, passes

    keys = [i * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63) for i in range(3_000)]
    held = bit_filter(spark.createDataFrame([(k,) for k in [*keys, None]], "k long"), "k", bits=1 << 18)
    assert passes(held, np.array(keys, dtype=np.int64).view(np.uint64)).all()
    others = np.arange(1, 50_001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    assert passes(held, others).mean() < 0.02
    assert not bit_filter(spark.createDataFrame([], "k long"), "k").any()
