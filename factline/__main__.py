"""python -m factline FACTS OUT: forecast from a .csv or .ttl of facts (named without suffix) and write the results."""

from __future__ import annotations

import argparse

from factline.operators import patterns, rules
from factline.plans.forecast import Settings, forecast
from factline.session import build_session
from factline.sources import facts as sources


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="factline", description=__doc__)
    p.add_argument("facts")
    p.add_argument("out")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--epochs", type=int, default=0, help="training epochs of the graph side")
    p.add_argument("--model", help="folder of the trained graph side; read if it is there, else written")
    p.add_argument("--rules", help="folder of rated rules; read if it is there, else written")
    p.add_argument("--replies", help="folder of the text model's replies; read, and added to")
    p.add_argument("--patterns", action="store_true", help="write the matches of the pattern catalogue as well")
    p.add_argument("--provider", default="silent", help="text model that takes decisions: one of replies.provider_names()")
    for switch in ("guide", "validity", "verify"):
        p.add_argument(f"--no-{switch}", action="store_true")
    a = p.parse_args(argv)
    spark = build_session("factline", a.master)
    facts = sources.load(spark, a.facts)
    ruled, ranked, metrics = forecast(facts, s=Settings(train_epochs=a.epochs, model_path=a.model, rules_path=a.rules, replies=a.replies, provider=a.provider, guide=not a.no_guide, validity=not a.no_validity, verify=not a.no_verify))
    rules.save(ruled, f"{a.out}/rules")
    ranked.write.mode("overwrite").parquet(f"{a.out}/answers")
    sources.write_json(metrics, f"{a.out}/metrics")
    sources.write_json(rules.statistics(ruled), f"{a.out}/rule-statistics")
    if a.patterns:
        patterns.save(patterns.match_all(facts), f"{a.out}/matches")
    metrics.show()


if __name__ == "__main__":
    main()
