"""Gates, contracts, profiling rules, provenance and slices: clean, dirty and cannot-run cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import contract as C
from plumbline.operators import filters as W
from plumbline.operators import gates as G
from plumbline.operators import profile as P
from plumbline.operators import prose, provenance, slices
from plumbline.operators.extract import guarded_repair


def status(df):
    return [r["status"] for r in df.collect()]


# ---- gates ------------------------------------------------------------------------------------------------

def test_gates_abstain_on_missing(spark):
    d = spark.createDataFrame([(None, 1.0, 1), (0.5, None, 0)], "pi double, x double, k int")
    empty = d.limit(0)
    assert status(G.inclusion_probs(d, "pi", 1)) == ["abstain"]
    assert status(G.bounded(empty, "x")) == ["abstain"]
    assert status(G.same_denominator(empty, [("pi", "x")], "x")) == ["abstain"]
    assert status(G.decomposition_reconciles(d, "x", 1.0)) == ["abstain"]
    est = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "s string, e double")
    assert status(G.published_is_conservative(est, "s", "e", "a")) == ["abstain"]
    with pytest.raises(G.GateError, match="abstain"):
        G.enforce(G.inclusion_probs(d, "pi", 1))


def test_structural_zero_flag_types(spark):
    d = spark.createDataFrame([(0.0, "False"), (1.0, "True")], "x double, seen string")
    with pytest.raises(TypeError):
        G.zero_is_structural(d, "x", "seen")
    b = spark.createDataFrame([(0.0, False), (0.0, True)], "x double, seen boolean")
    assert status(G.zero_is_structural(b, "x", "seen")) == ["fail"]
    odd = spark.createDataFrame([(0.0, 2)], "x double, seen int")
    assert status(G.zero_is_structural(odd, "x", "seen")) == ["abstain"]


def test_relative_denominator_and_sign_blind_conservatism(spark):
    d = spark.createDataFrame([(3e8 / 9e8, 3e8, 9e8), (0.0, 0.0, 7e8)], "r double, n double, d double")
    assert status(G.same_denominator(d, [("r", "n")], "d")) == ["pass"]
    e = spark.createDataFrame([("pub", -0.5), ("alt", -0.9), ("alt2", 0.6)], "s string, e double")
    assert status(G.published_is_conservative(e, "s", "e", "pub")) == ["pass"]
    assert status(G.published_is_conservative(e.union(spark.createDataFrame([("x", 0.1)])), "s", "e", "pub")) == ["fail"]
    with pytest.raises(G.GateError):
        G.draws_usable(d, F.lit(True), 0)


def test_exit_codes(spark):
    d = spark.createDataFrame([(1,), (1,)], "k int")
    assert G.exit_code(G.unique_key(d, ["k"])) == 1
    assert G.exit_code(G.unique_key(d.distinct(), ["k"])) == 0
    assert G.exit_code(G.bounded(d.limit(0), "k")) == 2


# ---- join contracts -----------------------------------------------------------------------------------------

def test_contract_nulls_and_predicted_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (4, "w")], "k int, g string")
    b = spark.createDataFrame([(1, 10), (1, 11), (None, 12), (9, 13)], "k int, v int")
    c = C.JoinContract(["k"], ["k"], card="1:m")
    p = C.predicted_rows(a, b, c).first()
    assert (p["inner_rows"], p["left_join_rows"]) == (5, 6)
    on = a["k"].eqNullSafe(b["k"])
    assert p["inner_rows"] == a.join(b, on).count() and p["left_join_rows"] == a.join(b, on, "left").count()
    r = {x["check"]: x["status"] for x in C.check_join(a, b, C.JoinContract(["k"], ["k"], card="m:1", how="inner", min_match=0.9)).collect()}
    assert r["right_unique"] == "fail" and r["left_unique"] == "pass" and r["left_rows_dropped"] == "fail" and r["left_match_rate"] == "fail"
    literal = spark.createDataFrame([("NA", 1)], "k string, v int")
    nulls = spark.createDataFrame([(None, "z")], "k string, g string")
    assert C.predicted_rows(nulls, literal, c).first()["inner_rows"] == 0  # null is not the text "NA"


def test_contract_refusals(spark):
    with pytest.raises(ValueError, match="refused"):
        C.JoinContract(["k"], ["k"], card="m:m")
    with pytest.raises(ValueError, match="left or inner"):
        C.JoinContract(["k"], ["k"], how="outer")
    e = spark.createDataFrame([], "k int")
    r = {x["check"]: x["status"] for x in C.check_join(e, e, C.JoinContract(["k"], ["k"])).collect()}
    assert r["left_match_rate"] == "abstain"


def test_group_rates_of_wide_groups(spark):
    a = spark.createDataFrame([(i, "ab"[i % 2] if i else None, str(i)) for i in range(40)], "k int, g string, w string")
    b = spark.range(0, 40, 2).select(F.col("id").cast("int").alias("k"))
    r = C.match_rate_by_group(a, b, C.JoinContract(["k"], ["k"], groups=["g", "w"])).toPandas()
    assert set(r["level"][r["group"] == "g"]) == {"a", "b"} and (r["group"] == "w").sum() == 40 and r["flag"].all()
    r = C.match_rate_by_group(a, b, C.JoinContract(["k"], ["k"], groups=["g", "w"], max_levels=20)).toPandas()
    wide = r[r["group"] == "w"]
    assert len(wide) == 1 and wide["level"].isna().all() and wide["n"].iloc[0] == 40 and wide["matched"].iloc[0] == 20 and wide["spread"].iloc[0] == 1.0 and (r["group"] == "g").sum() == 2


def test_spread_is_over_all_levels(spark):
    d = spark.createDataFrame([(f"l{i:02d}", -999.0 if i == 14 else float(i)) for i in range(15)], "g string, x double")
    assert P.sentinel_share_by_group(d, ["g"]).count() == 15
    few = P.sentinel_share_by_group(d, ["g"], max_levels=3).collect()
    assert len(few) == 3 and few[0]["spread"] == 1.0


# ---- profiling ------------------------------------------------------------------------------------------------

def test_key_search_and_missing_key(spark):
    d = spark.createDataFrame([(i // 10, i % 10, i % 3, 7) for i in range(100)], "a int, b int, c int, one int")
    r = P.find_minimal_key(d).first()
    assert r["size"] == 2 and set(r["columns"].split(" + ")) == {"a", "b"}
    assert P.find_minimal_key(spark.createDataFrame([(1, 2), (1, 2)], "a int, b int")).count() == 0
    m = P.shape_and_keys(d, ["A"]).first()
    assert m["status"] == "fail" and "a" in m["note"]


def test_key_search_sketches_no_combinations(spark, monkeypatch):
    """Combinations are refuted by drawn rows, the rest checked on all rows; nulls are a value and sit in no other column's place."""
    sketched, checked = [], []
    sketch, unique = P.F.approx_count_distinct, P._is_unique
    monkeypatch.setattr(P.F, "approx_count_distinct", lambda c, e: sketched.append(c) or sketch(c, e))
    monkeypatch.setattr(P, "_is_unique", lambda d, c: checked.append(tuple(c)) or unique(d, c))
    rows = [(i // 40, i % 40 if i % 40 else None, i % 7, (i * 7919) % 1500, 1) for i in range(3000)]
    d = spark.createDataFrame(rows, "a int, b int, c int, e int, one int")
    r = P.find_minimal_key(d).first()
    assert (r["size"], r["columns"]) == (2, "e + a") and all(isinstance(c, str) for c in sketched)
    assert checked[-1] == ("e", "a") and all(len(c) == 2 for c in checked)
    swapped = spark.createDataFrame([(None, 5), (5, None), (5, 5), (None, None)], "a int, b int")
    assert P.find_minimal_key(swapped).first()["columns"] in ("a + b", "b + a")
    assert P.find_minimal_key(d.unionByName(d)).count() == 0


def test_key_search_leaves_no_column_or_size_out(spark):
    """Keys of a column with few values among many columns, and of more than three; several single keys; none where whole rows repeat."""
    wide = spark.range(500).selectExpr(*[f"(id div 2 * {k + 3}) % 50 as c{k:02d}" for k in range(16)], "cast(id % 2 as int) as z", "id div 2 as y", "7 as one")
    assert [tuple(r) for r in P.find_minimal_key(wide).collect()] == [(2, "y + z")]
    bits = spark.range(16).selectExpr(*[f"if(id & {1 << k} = 0, null, {k}) as b{k}" for k in range(4)], "id % 2 as same")
    r = P.find_minimal_key(bits).collect()
    assert len(r) == 1 and r[0]["size"] == 4 and {"b1", "b2", "b3"} < set(r[0]["columns"].split(" + "))
    assert P.find_minimal_key(bits.unionByName(bits.limit(1))).count() == 0
    two = spark.range(400).selectExpr("id as x", "id % 7 as m", "cast(-id as string) as w")
    assert [tuple(r) for r in P.find_minimal_key(two).collect()] == [(1, "w"), (1, "x")]


def test_differences_seen_leave_what_can_be_a_key():
    import itertools
    import random
    draw = random.Random(3)
    for _ in range(200):
        m, differ = draw.randint(1, 7), []
        differ += [draw.randint(1, 2 ** m - 1) for _ in range(draw.randint(0, 5))]
        for size in range(1, m + 1):
            want = [c for c in itertools.combinations(range(m), size) if all(any(d >> k & 1 for k in c) for d in differ)]
            assert list(P._hitting(differ, m, size)) == want


def test_range_rules_use_whole_name_parts(spark):
    d = spark.createDataFrame([(-0.02, -1.0, -5.0, -2)], "vote_share double, mean_price double, super_x double, n_rows int")
    strict = {r["column"]: r["status"] for r in P.range_violations(d).collect()}
    assert strict == {"vote_share": "fail", "n_rows": "fail"}
    assert {r["column"] for r in P.range_violations(d, loose_names=True).collect()} == {"vote_share", "mean_price", "n_rows"}


def test_denominator_survives_nulls_and_zeros(spark):
    rows = [(float(i % 4), float(i) if i != 5 else None, (i % 4) / i if i not in (0, 5) else 0.0) for i in range(40)]
    r = P.denominators(spark.createDataFrame(rows, "hits double, seen double, hits_rate double")).first()
    assert r["denominator"] == "seen" and r["numerator"] == "hits"


def test_spike_and_type_trap(spark):
    d = spark.createDataFrame([(float(i) if i % 10 else 5099.0, "True" if i % 2 else "False") for i in range(1000)], "x double, b string")
    assert P.value_spikes(d).first()["value"] == 5099.0
    assert P.type_traps(d).first()["boolean_as_text"]


def test_assignment_levels_need_constant_treatment(spark):
    d = spark.createDataFrame([(i, i % 5, i % 7, int(i % 5 < 2)) for i in range(200)], "u int, site int, other int, w int")
    r = P.assignment_levels(d, "w", skip=["u"]).toPandas()
    assert list(r["column"]) == ["site"] and r["n_treated"][0] == 2


# ---- text and filters -------------------------------------------------------------------------------------------

def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


def test_number_tokens(spark):
    f = lambda t: sorted(one(spark, t, S.number_tokens))
    assert f("wells fell 37.5 below 8.06 metres by 1987") == [8.06, 37.5]
    assert f("6,021 of 1 and -0.7, on 19990712") == [-0.7, 6021.0]
    assert f("seasons 1988-1991") == [-1991.0]
    assert sorted(one(spark, "2 wells, 3.05 and 410", lambda c: S.number_tokens(c, precise_only=True))) == [3.05, 410.0]


def test_markup(spark):
    t = "wells 37.5\\% under 8.06 % draft says 55.1\n\\cite{deep:31.9} at \\gamma7 ```6.6```"
    assert sorted(one(spark, t, lambda c: S.number_tokens(S.strip_markup(c)))) == [8.06, 37.5]


def test_strict_literals(spark):
    d = spark.createDataFrame([(1, 2.0, ["a"])], "k bigint, x double, tags array<string>")
    for name, bad in (("k", "1"), ("k", 1.0), ("x", 2), ("tags", 3)):
        with pytest.raises(TypeError):
            W.check_literal(d, name, bad)
    assert d.where(W.filter_tree(d, {"OR": [{"k_gt": 5}, {"tags_has": "a"}]})).count() == 1
    with pytest.raises(KeyError):
        W.filter_tree(d, {"missing": 1})
    assert W.limited(spark.range(20_000), 50_000).count() == 20_000 and W.limited(spark.range(20_000), 15_000).count() == 15_000
    assert W.keyset_page(spark.range(20_000), "id", None, 12_000).count() == 12_000
    assert W.top_groups(spark.range(20_000), ["id"], F.count("*"), 11_000, "n").count() == 11_000


def test_catalogue_rules(spark):
    rows = [("ok", "ok", "fine"), ("a", "A b", "x"), ("b", "", "y"), ("c", "c", "z" * 201), ("d", "d-root", "<b>"), ("e", "x" * 65, "")]
    d = spark.createDataFrame(rows, "folder string, name string, description string")
    got = {}
    for r in prose.catalogue_violations(d, "folder", "name", "description", ["root"]).collect():
        got.setdefault(r["folder"], set()).add(r["rule"])
    assert "ok" not in got and got["b"] == {"name missing"} and got["c"] == {"description longer than 200"}
    assert got["a"] == {"name not lower-case letters, digits and hyphens", "name differs from folder"}
    assert got["d"] == {"name contains reserved word root", "name differs from folder", "description contains a tag"}
    assert got["e"] == {"name longer than 64", "name differs from folder", "description missing"}


def test_tells_ignore_quotes_and_need_clusters(spark):
    d = spark.createDataFrame([(1, 'He said "a vibrant tapestry" once.'), (2, "A vibrant tapestry — in order to delve, at its core."), (3, "One dash — here.")], "id int, t string")
    c = {r["id"]: r for r in prose.tell_clusters(d, ["id"], "t").collect()}
    assert c[1]["tells"] == 0 and c[2]["flag"] and not c[3]["flag"]


def test_repair_keeps_width(spark):
    d = spark.createDataFrame([("{7Kp",), ("plain",)], "x string")
    r = guarded_repair(d, "x", F.regexp_replace("x", r"\{7Kp", "7(Kp)"), "y").collect()
    assert r[0]["y"] == "{7Kp" and r[0]["y_declined"] and not r[1]["y_declined"]


# ---- provenance ----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def arts(spark):
    return spark.createDataFrame([("north/yield.txt", "41.37"), ("south/yield.txt", "58.02")], "path string, body string")


def test_paths_resolve_without_collapsing_folders(spark, arts):
    req = spark.createDataFrame([("report/north/yield",), ("yield",), ("./north//yield.txt",), ("harvest",), ("h/yield.txt",)], "cited_path string")
    r = {x["request"]: (x["status"], x["path"]) for x in provenance.resolve_citations(req, arts).collect()}
    assert r["report/north/yield"] == ("resolved", "north/yield.txt") and r["./north//yield.txt"][0] == "resolved"
    assert r["yield"] == ("ambiguous", None) and r["harvest"] == ("unresolved", None) and r["h/yield.txt"][0] == "unresolved"


def test_near_miss_and_exit_status(spark, arts):
    p = spark.createDataFrame([(1, "north/yield", "plots gave 41.52 against 41.37, once 73.6"), (2, "south/yield", "a flat 58.02")], "para_id long, cited_path string, text string")
    m = provenance.near_misses(p, p, arts).collect()
    assert [(r["para"], r["stated"], r["nearest"]) for r in m] == [(1, 41.52, 41.37)]
    assert sorted(r["value"] for r in provenance.orphans(p, arts).collect()) == [41.52, 73.6]
    ok = provenance.provenance_status(p, p, arts).first()
    assert (ok["exit_status"], ok["checked"], ok["stated"], ok["matched"]) == (1, 2, 4, 2)
    amb = p.union(spark.createDataFrame([(3, "yield", "near 66.4")]))
    assert provenance.provenance_status(amb, amb, arts).first()["exit_status"] == 2
    none = provenance.provenance_status(p, p, arts.where("path = 'x'")).first()
    assert none["exit_status"] == 2 and none["checked"] == 0


def test_near_misses_search_no_frame_anew_for_each_row(spark, arts):
    p = spark.createDataFrame([("p1", "a/results.txt", "it was 102.5 there")], "para_id string, cited_path string, text string")
    assert "unboundedfollowing" not in provenance.near_misses(p, p, arts)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_family_is_only_looked_for_where_its_literals_are(spark):
    d = spark.createDataFrame([(1, 'It serves as a "key role" and, of note, showcasing -- ** not only x but y.'), (2, "plain"), (3, None)], "id int, text string")
    for family, pattern in prose.TELLS.items():
        low = F.lower(F.regexp_replace("text", prose.QUOTED, " "))
        got = d.select("id", prose.family_count(F.lower(prose.own_words(F.col("text"))), family).alias("n"), F.regexp_count(low, F.lit(pattern)).alias("m")).collect()
        assert all(r["n"] == r["m"] for r in got), family
    assert all(prose.needed(f) for f in prose.TELLS if f != "emoji")


@pytest.mark.parametrize("cells", [None, 16])
def test_near_misses_equal_all_pairs(spark, cells):
    rng = np.random.default_rng(3)
    vals = np.unique(np.round(np.exp(rng.uniform(1, 9, 300)), 2))
    stated = np.unique(np.round(np.exp(rng.uniform(1, 9, 200)), 2))
    stated = np.array([x for x in stated if x >= 2.0 and x not in vals and not 1900 <= x < 2100])
    art = spark.createDataFrame([("a.txt", " ; ".join(f"{v:.2f}" for v in vals))], "path string, body string")
    par = spark.createDataFrame([(1, "a", " ; ".join(f"{v:.2f}" for v in stated))], "para_id long, cited_path string, text string")
    got = {r["stated"]: r["distance"] for r in provenance.near_misses(par, par, art, cells=cells).collect()}
    want = {}
    for v in stated:
        d = np.abs(vals - v) / vals
        if 0 < d.min() <= 0.03:
            want[round(float(v), 2)] = d.min()
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


# ---- slices: plant a known cause, then run on none --------------------------------------------------------------------

def simulated(spark, seed, planted):
    rng = np.random.default_rng(seed)
    n = 4_000
    d = {f"d{i}": rng.integers(0, rng.integers(2, 20), n) for i in range(6)}
    p = np.full(n, 0.1)
    if planted:
        p[d["d3"] == 0] = 0.3
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n) + seed * n, **d, "fail": (rng.random(n) < p).astype(int)}))


def test_planted_cause_is_found_and_nothing_else(spark):
    dims = [f"d{i}" for i in range(6)]
    found = [slices.disciplined_slice(simulated(spark, s, True), dims, "fail", "id").collect() for s in range(3)]
    assert sum(bool(r) and r[0]["dim"] == "d3" and r[0]["value"] == "0" and r[0]["confirmed"] for r in found) >= 2
    none = [slices.disciplined_slice(simulated(spark, 50 + s, False), dims, "fail", "id").where("confirmed").count() for s in range(4)]
    assert sum(none) <= 1


def test_decomposition_sums_even_with_new_segments(spark):
    d = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (1, "a", 2.0), (1, "c", 8.0)], "p int, s string, v double")
    r = slices.mix_decomposition(d, F.col("p"), "s", "v").agg(F.sum("within") + F.sum("mix")).first()[0]
    assert r == pytest.approx(5.0 - 2.0)


def test_citations_are_read_out_of_manuscripts(spark):
    from plumbline.operators import provenance as P
    text = ("Intro \\ref{sec:a, tab:one} and \\Cref{tab:two,tab:none} say 4,321.5.\n \t\nNo citation 99.\n\n\\begin{table}\\label{tab:one}\\input{tabs/a}\\input{ tabs/b.tex }\\end{table}"
            "\\begin{table*} \\input{c}\\label{tab:two} \\label{tab:three}\\end{table*}\n\n\\ref{tab:three} \\input{d/e}")
    d = spark.createDataFrame([(1, text), (2, "\\ref{tab:one}"), (3, None), (4, "")], "doc_id long, text string")
    got = {(r.para_id, r.cited_path) for r in P.read_citations(d).collect()}
    assert got == {("1:1", "tabs/a"), ("1:1", "tabs/b.tex"), ("1:1", "c"), ("1:1", "d/e"), ("1:1", "tab:none"), ("1:3", "tabs/a"), ("1:3", "tabs/b.tex"), ("1:3", "c"), ("1:4", "c"), ("1:4", "d/e"), ("2:1", "tab:one")}
    assert [(r.id, r.para) for r in P.manuscript_paragraphs(d).orderBy("id", "para").collect()] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (4, 1)]
    files = spark.createDataFrame([("x/tabs/a.tex", "4321.5 and 12"), ("c.tex", "4300"), ("y/c.tex", "1"), ("d/e.tex", "7")], "path string, body string")
    found = {r.request: (r.path, r.status) for r in P.resolve_citations(P.read_citations(d), files).collect()}
    assert found == {"tabs/a": ("x/tabs/a.tex", "resolved"), "tabs/b.tex": (None, "unresolved"), "c": ("c.tex", "resolved"), "tab:none": (None, "unresolved"), "tab:one": (None, "unresolved"), "d/e": ("d/e.tex", "resolved")}
    assert P.provenance_status(P.manuscript_paragraphs(d), P.read_citations(d), files).first().exit_status == 2
    assert P.read_citations(d.where("false")).count() == 0
