from __future__ import annotations

import pytest
from test_policy_files import VALID

from levyframe import Component, Policy, read_delimited, read_households, write_arrow_ipc
from levyframe.errors import LevyError
from levyframe.plans import run_scenario
from levyframe.sources import read_text_cells

CSV = "Age;GIR;x;y;z\n" + "".join(f"{60 + i};{1 + i % 2};{i}.5;1.25;2.75\n" for i in range(40))


def notif(age, gir, x, y, z, tau):
    return tau * x + y if age > 60 and gir == 1 else 0.3 * z


def expected(tau, share=0.8):
    out = []
    for i in range(40):
        value = notif(60 + i, 1 + i % 2, i + 0.5, 1.25, 2.75, tau)
        out.append((i + 1, 60 + i, 1 + i % 2, value * share, value))
    return out


VARIANT = VALID.replace("0.15", "0.25").replace('"plan_cons"', '"plan_kons"').replace("def plan_cons", "def plan_kons")


def test_csv_run_with_policy_files(spark, write, tmp_path):
    written = run_scenario(
        spark,
        write("h.csv", CSV),
        "csv",
        write("base.toml", VALID),
        write("variant.toml", VARIANT),
        folder=str(tmp_path / "out"),
        prefix="apa",
        trust_source=True,
    )
    assert sorted(written) == ["baseline", "diff", "variante"]
    assert written["variante"].endswith("/out/apa-variante-results.csv")
    base = read_delimited(spark, written["baseline"])
    assert base.columns == ["Index", "Age", "GIR", "plan_cons", "plan_notif", "x", "y", "z"]
    chosen = base.orderBy("Index").select("Index", "Age", "GIR", "plan_cons", "plan_notif")
    assert [tuple(r) for r in chosen.collect()] == expected(0.15)
    variant = read_delimited(spark, written["variante"]).orderBy("Index")
    assert [r["plan_notif"] for r in variant.collect()] == [row[4] for row in expected(0.25)]
    diff = read_text_cells(spark, written["diff"]).selectExpr("cast(Index AS int) i", "plan_notif", "plan_kons").orderBy("i")
    found = diff.collect()
    assert [float(r["plan_notif"]) for r in found] == [v[4] - b[4] for v, b in zip(expected(0.25), expected(0.15))]
    assert {r["plan_kons"] for r in found} == {None} or {r["plan_kons"] for r in found} == {""}


@pytest.mark.parametrize("kind", ["column", "python"])
def test_arrow_run(spark, tmp_path, kind):
    households = spark.range(50).selectExpr("cast(id AS int) n", "id / 8 x", "cast(id AS string) s")
    path = str(tmp_path / "h.arrow")
    write_arrow_ipc(households, path)
    base = Policy("b", [Component("due", lambda v, p, a: a["x"] * p["r"], {"r": 0.5}, kind=kind)])
    variant = Policy("v", [Component("due", lambda v, p, a: a["x"] * p["r"], {"r": 2}, kind=kind)])
    written = run_scenario(spark, path, "arrow", base, variant, folder=str(tmp_path / "out"))
    diff = read_households(spark, written["diff"], "arrow")
    assert diff.columns == ["n", "s", "x", "due"]
    assert sorted(tuple(r) for r in diff.collect()) == [(i, str(i), i / 8, i / 8 * 2.0 - i / 8 * 0.5) for i in range(50)]


def test_baseline_alone(spark, write, tmp_path):
    written = run_scenario(
        spark, write("h.csv", CSV), "csv", write("base.toml", VALID), folder=str(tmp_path), trust_source=True
    )
    assert list(written) == ["baseline"] and written["baseline"].endswith("/baseline-results.csv")
    assert read_delimited(spark, written["baseline"]).count() == 40


def test_faulty_runs(spark, write, tmp_path):
    policy, out = write("base.toml", VALID), str(tmp_path / "out")
    with pytest.raises(LevyError, match="format"):
        run_scenario(spark, write("h.csv", CSV), "xlsx", policy, folder=out)
    with pytest.raises(LevyError, match="depends on attributes the table lacks: GIR"):
        run_scenario(spark, write("g.csv", CSV.replace("GIR", "gir_")), "csv", policy, folder=out, trust_source=True)
    with pytest.raises(LevyError, match="Index"):
        run_scenario(spark, write("i.csv", CSV.replace("z\n", "Index\n", 1)), "csv", policy, folder=out, trust_source=True)
    with pytest.raises(LevyError, match="trust_source"):
        run_scenario(spark, write("h.csv", CSV), "csv", policy, folder=out)
    with pytest.raises(LevyError, match="no row"):
        run_scenario(spark, write("n.csv", CSV.split("\n")[0] + "\n"), "csv", policy, folder=out, trust_source=True)
    empty = str(tmp_path / "n.arrow")
    write_arrow_ipc(spark.range(0).selectExpr("cast(id AS int) n"), empty)
    one = Policy("p", [Component("c", lambda v, p, a: 1)])
    for variant in (None, one):
        with pytest.raises(LevyError, match="no row"):
            run_scenario(spark, empty, "arrow", one, variant, folder=out)
    assert not (tmp_path / "out").exists()
