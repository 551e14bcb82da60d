"""Unit conversion and packing: edge cases, brute force, bounds."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from weirgate.operators.packing import GROUP, balance, fill_rates, pack, pack_histogram, salted, step_group, tiers_of
from weirgate.operators.quantities import CANONICAL, CONVERSIONS, Mentions, compositions, number_value, quantities, unit_table

UNITS = [("mg", ["mg", None, " 毫克 "], "mass"), ("m", ["米", None], "length"), ("in", ["inch "], "length"), ("次/分", ["bpm"], None)]
SPELLED = {s: (kind, a, b) for s, kind, a, b in unit_table(UNITS)}
FIND = Mentions(SPELLED)


def amounts(text):
    return [(SPELLED[u][0], int(v * SPELLED[u][1] + SPELLED[u][2] + 0.5 + 1e-9)) for u, v in FIND(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("体重三千零二十四克", [("mass", 3024 * 10**6)]),
        ("一次用０．４ mg", [("mass", 400)]),
        ("引流出1.8×10^3 mL", [("volume", 1800)]),
        ("身高1米65，我高1米7", [("length", 1650), ("length", 1700)]),
        ("身高5英尺7英寸", [("length", 1702)]),
        ("血压24 / 11.7 千帕", [("pressure", 180), ("pressure", 88)]),
        ("BP was 156/87 mm Hg.", [("pressure", 156), ("pressure", 87)]),
        ("血糖/mg/dL：180", [("glucose", 100)]),
        ("饮水量（mL）：2400，体温(°F)：98.6", [("volume", 2400), ("temperature", 370)]),
        ("Dose in mg: 4500", [("mass", 4500000)]),
        ("The temperature read 39.5 C.", [("temperature", 395)]),
        ("按每公斤体重 5mg/kg 计算，HGB 139 g/L，面积 24 m²，心率72次/分，5岁，占比3.5%", []),
        ("总胆固醇 5.2 mmol/L", []),
        ("血压120/80，没有单位", []),
        ("血压(mmHg)：120/80", [("pressure", 120), ("pressure", 80)]),
        ("第90页写着 mg 这个单位", []),
        ("一" * 20000 + "mg", []),
        ("", []),
    ],
)
def test_mentions(text, want):
    assert amounts(text)[: len(want) or None] == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("身高175cm，70kg", [("length", 1750), ("mass", 70 * 10**9)]),
        ("体温，38.5℃", [("temperature", 385)]),
        ("身高，1米75", [("length", 1750)]),
        ("心率80，70kg，1，234mg", [("mass", 70 * 10**9), ("mass", 1234000)]),
        ("He rested.70kg was read", [("mass", 70 * 10**9)]),
        ("-20℃", [("temperature", -200)]),
        ("贮存于-20℃~−5℃，T:-3℃", [("temperature", -200), ("temperature", -50), ("temperature", -30)]),
        ("出入量 -500mL，服药+5mg", [("volume", -500), ("mass", 5000)]),
        ("体重-70kg，血压-120/80mmHg", [("mass", 70 * 10**9), ("pressure", 120), ("pressure", 80)]),
        ("36℃-38℃，5mg - 10mg", [("temperature", 360), ("temperature", 380), ("mass", 5000), ("mass", 10000)]),
        ("BP120/80mmHg，T38.5℃，WT70 kg，GLU5.6mmol/L", [("pressure", 120), ("pressure", 80), ("temperature", 385), ("mass", 70 * 10**9), ("glucose", 56)]),
        ("PaCO2 mmHg，B12 mg，CD4 in 2019，IL-6 in 2019，No.5 mg，TG1.7mmol/L，Na+140mmol/L，总胆固醇，5.2mmol/L", []),
        ("36-38℃，三十-四十公斤，175,70kg", []),
        ("a1" * 20000 + "1," * 20000 + "-1" * 20000 + "kg", []),
    ],
)
def test_mentions_after_commas_signs_and_letters(text, want):
    assert [(SPELLED[u][0], math.floor(v * SPELLED[u][1] + SPELLED[u][2] + 0.5 + 1e-9)) for u, v in FIND(text)] == want


def test_number_words():
    assert [number_value(x) for x in ("一百零二", "二百五十", "十", "两", "三十六点五", "1,500", ".25", "二百五", "点")] == [102, 250, 10, 2, 36.5, 1500, 0.25, 250, None]


def test_conversion_cycles():
    f = compositions(CONVERSIONS, CANONICAL.values())
    assert f["°F", "0.1 °C"] == (Fraction(50, 9), Fraction(-1600, 9)) and f["lb", "μg"][0] == 453592370
    with pytest.raises(ValueError):
        compositions([*CONVERSIONS, ("lb", "mg", "450000", "0")], CANONICAL.values())


def test_quantities_edges(spark):
    schema = "record_id long, messages array<struct<role:string,content:string>>, quantity string"
    rows = [(1, [("user", "用5mg，再用5 毫克"), (None, None), None], "x"), (1, [("user", "用5mg，再用5 毫克")], "y"), (2, None, None), (3, [], ""), (None, [("user", "5mg")], "")]
    units = spark.createDataFrame(UNITS + [(None, None, "mass")], "name string, aliases array<string>, quantity string")
    got = quantities(spark.createDataFrame(rows, schema), units).collect()
    assert [tuple(r) for r in got] == [(1, 0, "mass", 5000)]
    assert quantities(spark.createDataFrame([], schema), units).count() == 0


def test_histogram_packing_keeps_everything():
    r = random.Random(2)
    for _ in range(30):
        cap = r.choice((10, 64, 512))
        counts = {s: r.randrange(1, 50) for s in {r.randrange(1, cap + 1) for _ in range(r.randrange(0, 40))}}
        patterns = pack_histogram(counts, cap, tiers_of(cap))
        back: dict = {}
        for p in patterns:
            assert sum(s * n for s, n in p.items) <= cap and p.copies > 0
            for s, n in p.items:
                back[s] = back.get(s, 0) + n * p.copies
        assert back == counts
        if counts:
            boxes, least = sum(p.copies for p in patterns), -(-sum(s * n for s, n in counts.items()) // cap)
            assert boxes <= 1.5 * least + 2
    with pytest.raises(ValueError):
        pack_histogram({11: 1}, 10, [10])


def test_tiers_steer_the_packing():
    r = random.Random(4)
    counts = {s: r.randrange(1, 20) for s in r.sample(range(1, 513), 200)}
    filled = lambda tiers: Counter({tuple(sorted(p.items)): p.copies for p in pack_histogram(counts, 512, tiers)})
    by_tier, flat = filled(tiers_of(512)), filled([512])
    assert by_tier != flat
    for p in pack_histogram(counts, 512, tiers_of(512)):
        opener = max(s for s, _ in p.items)
        assert p.tier == min(t for t in tiers_of(512) if t >= opener) and p.gap == 512 - sum(s * n for s, n in p.items)
    assert sum(by_tier.values()) <= 1.01 * sum(flat.values())
    # items of a tier are packed among themselves before shorter ones fill the gaps
    assert [sorted(p.items) for p in pack_histogram({30: 2, 33: 1, 4: 3}, 64, [32, 64])] == [[(30, 1), (33, 1)], [(4, 3), (30, 1)]]


def test_step_groups_are_balanced_in_cost():
    r = random.Random(9)
    counts = {s: r.randrange(1, 200) for s in r.sample(range(1, 513), 300)}
    costs = sorted((p.cost for p in pack_histogram(counts, 512, tiers_of(512)) for _ in range(p.copies)), reverse=True)
    groups = -(-len(costs) // GROUP)
    place = np.arange(len(costs))
    ratio = lambda group: (sums := np.bincount(group, costs)).max() / sums.mean()
    assert ratio(step_group(place, groups)) < min(1.1, ratio(place % groups), ratio(place // GROUP))


def test_large_classes_are_salted(spark):
    sized = spark.createDataFrame([(i, 7, "") for i in range(100)] + [(i, 9, "legal") for i in range(5)], "doc_id long, n_tokens int, kind string")
    got = Counter((x.n_tokens, x.salt) for x in salted(sized, 20).collect())
    assert len([k for k in got if k[0] == 7]) == 5 and got[9, 0] == 5 and sum(got.values()) == 105


def test_step_groups_hold_as_many_containers(spark):
    from weirgate.functions.tokens import vocabulary_path

    texts = ["word " * n for n in [*range(1, 60), *[200, 201, 202, 203] * 10, 320, 1000]]
    docs = spark.createDataFrame([(i // 2, t, None) for i, t in enumerate(texts)], "doc_id long, text string, domain string")
    profiles = spark.createDataFrame([(1, 16, None), (2, 64, None), (3, 1, None)], "profile_id int, capacity int, domain string")
    rows = pack(docs, profiles, vocabulary_path("byte_bpe_multi_50k.tiktoken")).collect()
    for p in (1, 2, 3):
        # repeated doc_ids have full parts of one name: each row is a container of its own
        boxes = {(r.step_group, r.container_id) for r in rows if r.profile_id == p and r.container_id[0] == "b"}
        held = Counter([g for g, _ in boxes] + [r.step_group for r in rows if r.profile_id == p and r.container_id[0] == "d"])
        assert max(held.values()) - min(held.values()) <= 1 and max(held.values()) <= GROUP and len(held) == -(-sum(held.values()) // GROUP)


def test_packing(spark):
    from weirgate.functions.tokens import encoder, vocabulary_path

    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    texts = ["word " * n for n in (1, 5, 9, 9, 9, 40, 100, 3, 0)] + [None, "", "同一文本" * 30, "同一文本" * 30]
    docs = spark.createDataFrame([(i, t, ["法律", "medical", None][i % 3], 1) for i, t in enumerate(texts)] + [(None, "x", None, 1)], "doc_id long, text string, domain string, size int")
    profiles = spark.createDataFrame([(1, 16, None), (2, 64, "legal")], "profile_id int, capacity int, domain string")
    rows = pack(docs, profiles, path).collect()
    sizes = {i: len(encoder(path).encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    for p, cap, own in ((1, 16, range(13)), (2, 64, range(0, 13, 3))):
        mine = [r for r in rows if r.profile_id == p]
        boxes: dict = {}
        for r in mine:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.part_tokens
            assert r.part == 0 or sizes[r.doc_id] > cap
        assert max(boxes.values()) <= cap
        for i in own:
            parts = sorted((r.part, r.part_tokens) for r in mine if r.doc_id == i)
            assert [k for k, _ in parts] == list(range(len(parts))) and parts and sum(n for _, n in parts) == sizes[i]
        assert {r.doc_id for r in mine} == set(own)
    rates = {r.profile_id: r.filled for r in fill_rates(pack(docs, profiles, path), profiles).collect() if r.tier is None}
    assert len(rates) == 2 and all(0.5 < f <= 1 for f in rates.values())
    assert {r.profile_id for r in balance(pack(docs, profiles, path)).collect()} == {1, 2}
    assert pack(docs.limit(0), profiles, path).count() == 0
    with pytest.raises(ValueError):
        pack(docs, spark.createDataFrame([(1, None, None)], "profile_id int, capacity int, domain string"), path)
