import pytest

from faultweave.llm.decontam import contaminated, without_contaminated

from conftest_text import filler

ITEM = "If Alice drives 120 km in 3 hours and then walks 4 km with Alice and Bob, how far did they travel in total before the evening came?"
PLAIN = "the river runs slowly past the old mill where nobody has worked since the great flood of that cold winter"


def items(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, h string")


def found(docs, bench, **kw):
    return {(r.doc_id, r.item_id): r for r in contaminated(docs, bench, **kw).collect()}


def test_copies_and_new_parameters(spark, docs_of):
    other = ITEM.replace("120 km", "85,5 miles").replace("3 hours", "2 days").replace("Alice", "Marie Curie").replace("Bob", "Pierre")
    mixed = other.replace("with Marie Curie", "with Someone").replace("4 miles", "9 miles")
    docs = docs_of([(1, filler(1) + ITEM + filler(2)), (2, filler(3) + " " + other), (3, filler(4)), (4, PLAIN.upper() + "!"), (5, mixed), (6, None), (7, ""), (8, ITEM[:50]), (1, filler(1) + ITEM + filler(2))])
    bench = items(spark, [(10, ITEM), (11, PLAIN), (12, None), (13, "too short"), (14, "5 6 7 8 9 10 11 12 13 14")])
    got = found(docs, bench)
    assert {k for k in got if k[0] != 5} == {(1, 10), (2, 10), (4, 11)}
    assert got[1, 10].verbatim and got[1, 10].slot_consistency == 1.0 and got[1, 10].n_slots >= 4
    # 'km' became 'miles' once and stayed once.
    assert not got[2, 10].verbatim and got[2, 10].slot_consistency == 7 / 8
    assert (5, 10) not in found(docs, bench, consistency=0.9)
    gone = {i for i, _ in got}
    assert sorted(r.doc_id for r in without_contaminated(docs, contaminated(docs, bench)).collect()) == sorted({1, 2, 3, 4, 5, 6, 7, 8} - gone)


def test_short_items_and_empty_tables(spark, docs_of):
    bench = items(spark, [(1, "red green blue yellow violet")])
    docs = docs_of([(1, "x y red, green blue\nyellow violet z"), (2, "red green blue yellow")])
    assert set(found(docs, bench)) == {(1, 1)}
    assert not found(docs, bench.limit(0)) and not found(docs.limit(0), bench)


def test_brute_force(spark):
    import os
    import re
    from collections import defaultdict

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no data")
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    split = lambda t: re.findall(r"[^\W\d_]+|\d+", (t or "").lower())
    places, n = defaultdict(set), {}
    for r in bench.collect():
        w = split(r.text)
        n[r.item_id] = len(w) - 7
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].add((r.item_id, k))
    want = set()
    for r in docs.collect():
        w, held = split(r.text), defaultdict(set)
        for k in range(len(w) - 7):
            for i, p in places.get(tuple(w[k : k + 8]), ()):
                held[i].add(p)
        want |= {(r.doc_id, i) for i, s in held.items() if len(s) >= 0.5 * n[i]}
    assert set(found(docs, bench)) == want and want


def test_no_python_in_the_plan(spark, docs_of):
    plan = contaminated(docs_of([(1, ITEM)]), items(spark, [(1, ITEM)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_templates_that_repeat(spark, docs_of):
    """Slots are judged where the copy stands, not at the first place of each window."""
    inside = "Anna buys 3 apples and 4 pears at the big market today. Later Anna buys 5 apples and 6 pears at the big market today. What did it cost?"
    part = "drives 77 km in 8 hours and then walks 9 km with Carol and Dora, how far did they travel."
    pieces = ITEM.replace("in 3 hours and", "in 3 hours of rain and")
    docs = docs_of([(1, inside), (2, filler(1) + part + filler(2) + ITEM), (3, filler(3) + part + filler(4) + pieces), (4, filler(5) + inside.replace("Anna", "Maria"))])
    bench = items(spark, [(1, inside), (2, ITEM)])
    got = found(docs, bench)
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 1)}
    assert got[1, 1].coverage == 1.0 and got[1, 1].slot_consistency == 1.0 and got[1, 1].verbatim and got[2, 2].verbatim and got[3, 2].verbatim


def test_names_at_sentence_starts_and_other_letter_case(spark, docs_of):
    apples = 'Tom has 12 red apples. Tom gives 3 to Ann. Tom eats 2 more today. How many are left?'
    quoted = 'Tom has 12 red apples. "Tom gives 3 to Ann", (Tom eats 2 more today). How many are left?'
    crowd = "Yesterday Ann and Bob met Carl, Dora and Emil while Fred, Gina and Hugo saw Ina with Jon and Karl."
    other = lambda t: t.replace("Tom", "Sam").replace("Ann", "Joe").replace("12", "15").replace("3", "4").replace("2 more", "7 more")
    docs = docs_of([(1, other(apples)), (2, filler(1) + other(quoted)), (3, crowd.upper()), (4, crowd.lower()), (5, "\n" + other(apples).replace("Sam", "SAM")), (6, other(apples).replace("Sam gives", "Max gives").replace("Sam eats", "Leo eats"))])
    got = found(docs, items(spark, [(1, apples), (2, quoted), (3, crowd)]))
    assert {(1, 1), (2, 2), (3, 3), (4, 3), (5, 1)} <= set(got) and (6, 1) not in got
    assert got[3, 3].coverage == 1.0 and got[3, 3].verbatim and not got[1, 1].verbatim


def test_long_lists_of_names_and_numbers(spark, docs_of):
    """The regexes need no stack for repeats."""
    bench = items(spark, [(1, ITEM)])
    docs = docs_of([(1, "the " + "Anna " * 20_000 + ITEM), (2, "1," * 20_000 + "5 " + ITEM), (3, "x " + "Ab" * 20_000), (4, "Z" * 50_000 + " " + "9" * 50_000)])
    assert set(found(docs, bench)) == {(1, 1), (2, 1)}


def test_one_passage_has_to_hold_the_item(spark, docs_of):
    """Another variant before the copy does no harm; pieces far apart are no copy."""
    words = PLAIN.split()
    apart = " ".join(words[:9]) + " " + filler(1, 60) + " " + " ".join(words[9:])
    decoy = "drives 99 km in 8 hours and then walks 9 km with Carol and Dora, how far did they travel"
    copy = ITEM.replace("120", "77").replace("Alice", "Maria").replace("Bob", "Paul")
    docs = docs_of([(1, apart), (2, f"{decoy} {filler(2)} {copy}"), (3, filler(3) + PLAIN + filler(4) + PLAIN)])
    got = found(docs, items(spark, [(1, PLAIN), (2, ITEM)]), coverage=0.6)
    assert set(got) == {(2, 2), (3, 1)} and got[2, 2].slot_consistency == 1.0 and not got[2, 2].verbatim


def test_two_instances_of_one_template(spark, docs_of):
    one, two = (f"Maria packs {a} boxes with {b} books each and sends {c} boxes to the old school, how many books stay?" for a, b, c in ((3, 9, 2), (40, 50, 6)))
    got = found(docs_of([(1, one + " " + filler(1) + " " + two)]), items(spark, [(1, one), (2, two)]))
    assert set(got) == {(1, 1), (1, 2)} and got[1, 1].verbatim and got[1, 2].verbatim


def test_clashing_columns(spark, docs_of):
    docs = docs_of([(1, ITEM), (2, filler(3))]).withColumnsRenamed({"score": "_key", "key": "_KEY_A"})
    kept = without_contaminated(docs, contaminated(docs, items(spark, [(1, ITEM)])))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in docs.where("doc_id = 2").collect()]


LONG = " ".join(f"{w}{i}" if i % 9 == 4 else w for i, w in enumerate(filler(77, 320).split()))
ODD_ITEMS = [
    (1, ITEM), (1, ITEM), (1, ITEM), (2, PLAIN), (2, "a quite different question about seven sleepy badgers in one deep burrow near the lake"),
    (3, "Compute 345 + 678"), (4, "What is love?"), (5, "yes"), (6, "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3"), (None, PLAIN), (7, LONG), (8, None), (9, ""), (10, "love"),
]
ODD_DOCS = [
    (1, filler(31) + ITEM), (2, filler(32) + "a quite different question about seven sleepy badgers in one deep burrow near the lake" + filler(33)), (3, "please COMPUTE 345, 678 now"),
    (4, "compute 346 + 678"), (5, "he asked: what is love"), (6, "yes, what love is"), (7, "pi: 3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3 2"), (8, "pi: 3 1 4 1 5 9 2 6 5 4 5 8 9 7 9 3 2"),
    (9, filler(34) + " ".join(LONG.split()[100:160]) + filler(35)), (10, filler(36) + " ".join(LONG.split()[100:140]) + filler(37)), (11, "the " + ITEM), (12, None), (13, PLAIN + ". " + PLAIN),
]


def test_repeated_short_and_long_items(spark, docs_of):
    """Rows that repeat an item are one; each text under an id counts; short and numeric
    items are held as whole sequences; of a long one a passage is enough."""
    got = found(docs_of(ODD_DOCS), items(spark, ODD_ITEMS))
    assert set(got) == {(1, 1), (2, 2), (3, 3), (5, 4), (7, 6), (9, 7), (11, 1), (13, 2)}
    assert got[1, 1].coverage == 1.0 and got[2, 2].verbatim and got[5, 4].n_windows == 1 and got[7, 6].coverage == 1.0 and got[9, 7].coverage < 0.5
    # A word put before the first name hides it from one form; the best form is told.
    assert got[11, 1].verbatim and got[11, 1].slot_consistency == 1.0


def test_sql_agrees_on_odd_items(spark, docs_of, tmp_path):
    import duckdb

    from faultweave.llm.queries import op3_decontamination, oracle_sql

    docs_of(ODD_DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    items(spark, ODD_ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = op3_decontamination(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op3_decontamination']})").fetchall()
    assert want and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_text_that_repeats_itself(spark, docs_of):
    """Very many ways to lay an item are dealt into parts; the copy among them is found."""
    def text(seed, n):
        return " ".join(f"Then Alice Brown gave {(seed * i * i + i) % 9} red apples and {(seed + i * 5) % 7} green pears to the old man near Paris today." for i in range(n))

    item = text(1, 6)
    docs = docs_of([(1, text(2, 150) + " " + item + " " + text(3, 150)), (2, text(2, 300)), (3, item.replace("old", "very old"))])
    got = found(docs, items(spark, [(7, item)]))
    assert got[1, 7].verbatim and got[1, 7].coverage == 1.0
    assert (2, 7) not in got or not got[2, 7].verbatim
    assert (3, 7) in got
