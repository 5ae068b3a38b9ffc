"""python -m tessera COMMAND FOLDER: the main reports, over the panels of a folder of tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

REPORTS = {
    "momentum": ("backtest_summary", "buy_and_hold", "monthly_curve", "top_moves"),
    "survivorship": ("coverage_gate", "survivorship_gap"),
    "diagnose": ("top_days_drivers", "concentration", "up_days", "diversification", "name_totals"),
    "membership": ("snapshot_spacing", "removal_clusters", "membership_spells", "member_days"),
    "quality": ("flag_suspects", "truncate_suspects", "trim_ragged_end"),
}


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=[*REPORTS, "suite", "compare", "check", "query", "registry"])
    p.add_argument("folder", nargs="?")
    p.add_argument("--universe", default="current", choices=["current", "point_in_time"])
    p.add_argument("--raw", action="store_true", help="top minus bottom, whatever is predicted")
    p.add_argument("--name", help="a query's name")
    p.add_argument("--store", help="a folder that keeps the suite's verdicts; check reads it")
    p.add_argument("--out", help="a folder for the result as Parquet, instead of printing it")
    a = p.parse_args(arguments)
    from tessera.operators import scoring

    if a.command == "registry":
        for x in scoring.ANOMALIES:
            print(f"{x.key:26} {x.feature:14} {x.direction:+d} {x.published_sharpe:.2f}  {x.citation}")
        print(scoring.digest())
        return 0
    if not a.folder:
        p.error("a folder is needed")
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans import registry, suite
    from tessera.plans.adapters import Inputs

    if a.command == "check":
        from tessera.plans import publishing

        problems = publishing.check_store(spark.read.parquet(a.store or a.folder))
        print("\n".join(problems) or f"no stale or repeated verdicts; registry {scoring.digest()[:12]}")
        return int(bool(problems))
    if a.command == "compare":
        frames = {"gap": registry.QUERIES["universe_gap"](spark, a.folder)}
    elif a.command == "suite" and a.store:
        from tessera.plans import publishing

        inputs = Inputs(spark, a.folder)
        try:
            n = publishing.store_suite(suite.score(inputs, a.universe, orient=not a.raw), a.universe, inputs.days.count(), a.store)
        except publishing.PublishError as e:
            print(f"not stored: {e}", file=sys.stderr)
            return 1
        print(f"{n} verdicts of {a.universe} stored")
        return 0
    elif a.command == "suite":
        frames = {"suite": suite.score(Inputs(spark, a.folder), a.universe, orient=not a.raw).select("key", "verdict", "oriented_sharpe", "deflated_psr", "p_value_adjusted", "reasons")}
    else:
        names = [a.name] if a.command == "query" else REPORTS[a.command]
        if unknown := [n for n in names if n not in registry.QUERIES]:
            p.error(f"no query {unknown[0]!r}; there are: {', '.join(registry.QUERIES)}")
        frames = {n: registry.QUERIES[n](spark, a.folder) for n in names}
    for name, df in frames.items():
        if a.out:
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        else:
            print(f"\n{name}")
            df.show(40, truncate=60)
    if a.command == "survivorship" and frames["coverage_gate"].first().blocked:
        print("coverage is incomplete: the gap is not to be trusted", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
