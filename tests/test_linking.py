"""Chains of parts, entity matching and enrichment against plain versions."""

import random
import re

from evidentia.operators import linking


def test_chains_of_every_length_and_cycles(spark):
    rng = random.Random(3)
    parents = {}
    for length, base in ((1, 0), (2, 10), (3, 20), (5, 30), (9, 50), (17, 80), (33, 120)):
        parents |= {base + i: base + i - 1 for i in range(1, length + 1)}
    parents |= {500: 501, 501: 502, 502: 500, 510: 500, 511: 510, 520: 520}
    rows = [*parents.items(), (30, None), (None, 3), (31, 9999)]
    rng.shuffle(rows)
    got = {r.entry_id: (r.root_id, r.depth, r.cycle) for r in linking.part_chains(spark.createDataFrame(rows, "entry_id long, parent_id long")).collect()}

    def plain(i):
        seen, at = set(), i
        while at in parents:
            if at in seen:
                return None, None, True
            seen.add(at)
            at = parents[at]
        return at, len(seen), False

    assert got == {i: plain(i) for i in parents}
    assert linking.part_chains(spark.createDataFrame([], "entry_id long, parent_id long")).count() == 0


def ratio(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, above = [i], row
        for j, b in enumerate(y, 1):
            row.append(above[j - 1] if a == b else 1 + min(above[j], row[j - 1]))
    return 100.0 * (1 - row[-1] / (len(x) + len(y))) if x or y else 100.0


def token_set_ratio(a, b):
    p, q = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    if not p or not q:
        return 0.0
    both, left, right = " ".join(sorted(p & q)), " ".join([*sorted(p & q), *sorted(p - q)]), " ".join([*sorted(p & q), *sorted(q - p)])
    if both and (p <= q or q <= p):
        return 100.0
    return max(ratio(both, left), ratio(both, right), ratio(left, right)) if both else ratio(left, right)


def test_entities_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK_LOT", 5)
    rng = random.Random(5)
    words = ["Johann", "Sebastian", "Bachmann", "Maria", "Theresa", "Lindqvist", "Holt", "de", "la", "Ferrari", "Étienne"]

    def damaged(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i:]]) or w

    labels = [(f"e{i:03}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), ["composer"] if i % 4 else ["play"], i % 7) for i in range(120)]
    names = [" ".join(map(damaged, rng.choice(labels)[1].split())) for _ in range(80)]
    df = spark.createDataFrame([*((n,) for n in names), (None,), ("",), (names[0],)], "name string")
    entities = spark.createDataFrame([*labels, ("e900", None, ["composer"], 0)], "entity_id string, label string, kinds array<string>, place int")
    got = {r.name: r.entity_id for r in linking.match_entities(df, entities, ["composer"]).collect()}
    want = {}
    for n in names:
        hits = [(place, i) for i, label, kinds, place in labels if "composer" in kinds and token_set_ratio(n, label) >= linking.SIMILAR]
        if hits:
            want[n] = min(hits)[1]
    same = sum(got.get(n) == e for n, e in want.items())
    assert set(got) <= set(want) and len(want) > 40
    assert same / len(want) >= 0.95  # what blocks miss


def test_enrichment_keeps_what_a_person_confirmed(spark):
    works = spark.createDataFrame(
        [(1, "Ada Linde", "Op", 3, "", None, False, False, None, None, None), (2, "Ada Linde", "Op", 4, "", 1850, None, True, None, "x", "own"), (3, "Ada Linde", "Op", 3, "", None, None, None, None, None, None), (4, None, "Op", 3, "", None, None, None, None, None, None)],
        "work_id long, composer_name string, system string, number int, suffix string, year int, looked_up boolean, confirmed boolean, match_note string, s_id string, s_title string",
    )
    copies = spark.createDataFrame([(1, "pending", "accept"), (1, "accepted", "hold"), (2, "accepted", "hold"), (3, "pending", "review"), (4, "accepted", "accept")], "work_id long, review_state string, route string")
    entries = spark.createDataFrame([("s9", "Suite, Op. 3 (Linde)", None, 1, 1844), ("s8", "Air, Op. 4 (Linde)", None, 1, 1846)], "entry_id string, title string, credits string, place int, year int")
    once = linking.enrich(works, copies, {"s": entries})
    got = {r.work_id: (r.s_id, r.year, r.looked_up, r.message) for r in once.collect()}
    assert got == {1: ("s9", 1844, True, "s, year"), 2: ("x", 1850, None, "confirmed by hand"), 3: (None, None, None, "no accepted copy yet"), 4: (None, None, None, "no composer")}
    assert {r.work_id: r.message for r in linking.enrich(once.drop("message"), copies, {"s": entries}).collect()}[1] == "already looked up"
    forced = {r.work_id: (r.s_id, r.s_title, r.year) for r in linking.enrich(works, copies, {"s": entries}, force=True).collect()}
    assert forced[2] == ("s8", "Air, Op. 4 (Linde)", 1846)
