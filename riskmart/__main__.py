"""Command line: the reference's entry points as Spark jobs.

  python -m riskmart build-features --raw DIR [--fmt csv|parquet] --out DIR [--force] [--skip-validation]
  python -m riskmart validate       --raw DIR [--fmt csv|parquet]
  python -m riskmart train          --raw DIR [--fmt ...] --models DIR [--config YAML] [--version v2]
  python -m riskmart tune           --raw DIR [--fmt ...] --out DIR [--trials N] [--timeout S] [--config YAML] [--family xgboost|lightgbm]
  python -m riskmart explain        --raw DIR [--fmt ...] --models DIR --out DIR
  python -m riskmart score          --requests DIR --out DIR --models DIR [--version V] [--stream [--rejects DIR]]
  python -m riskmart activate       --models DIR --version V
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def _spark():
    from riskmart.session import get_spark

    return get_spark()


def _tables(spark, args):
    from riskmart.sources import tables as TB

    return TB.load_all(spark, args.raw, args.fmt)


def _cfg(args):
    from riskmart.operators import training as TR

    return TR.load_config(args.config)[0] if getattr(args, "config", None) else TR.ModelConfig()


def cmd_build(args) -> dict:
    from riskmart.plans import master as M

    spark = _spark()
    df = M.load_or_build_master(spark, args.raw, args.out, args.fmt, force_rebuild=args.force,
                                validate=not args.skip_validation)
    return {"rows": df.count(), "columns": len(df.columns)}


def cmd_validate(args) -> dict:
    from riskmart.operators import quality as Q

    report = Q.validate_tables(_tables(_spark(), args), raise_on_error=False)
    return {"checks": [r.asDict() for r in report.collect()]}


def cmd_train(args) -> dict:
    from riskmart.plans import train_run

    spark = _spark()
    return train_run.train(_tables(spark, args), args.models, _cfg(args), args.version,
                           validate=not args.skip_validation)


def cmd_tune(args) -> dict:
    from riskmart.operators import search as SE
    from riskmart.operators import training as TR
    from riskmart.plans import master as M
    from riskmart.plans.train_run import development_split
    from riskmart.sources import tables as TB

    spark = _spark()
    cfg = _cfg(args)
    master = SE.search_input(M.build_master(_tables(spark, args)))
    dev, _ = development_split(master, cfg)
    if args.family:
        from riskmart.operators import study as ST

        trials, best = ST.tune_family(dev, args.family, cfg, n_trials=args.trials, timeout_s=args.timeout)
    else:
        trials, best = SE.run_search(dev, args.trials, args.timeout, cfg=cfg)
    TB.write_table(trials, f"{args.out.rstrip('/')}/search_trials")
    return best


def cmd_explain(args) -> dict:
    from riskmart.plans import train_run
    from riskmart.sources import tables as TB

    spark = _spark()
    contribs, importance = train_run.explain_holdout(_tables(spark, args), args.models, _cfg(args))
    TB.write_table(contribs, f"{args.out.rstrip('/')}/contributions")
    TB.write_table(importance, f"{args.out.rstrip('/')}/global_importance")
    return {"top_features": [r["feature"] for r in importance.collect()]}


def cmd_score(args) -> dict:
    """Score request files with the saved pipeline: constraints -> features -> probability -> band."""
    from riskmart.operators import quality as Q
    from riskmart.operators import scoring as SC
    from riskmart.operators import training as TR
    from riskmart.streaming.scoring_stream import REQUEST_SCHEMA, start_scoring_service, start_scoring_stream

    spark = _spark()
    model, meta = TR.load_artifacts(args.models, (args.version,) if args.version else None)
    names = meta["feature_names"]
    threshold = float(meta.get("threshold", 0.5))

    def transform(requests):
        checked = Q.row_constraints(requests)
        feats = SC.request_features(checked, keep=("id", "is_valid", "reasons"))
        aligned, _ = SC.align_features(feats, names, keep=("id", "is_valid", "reasons"))
        out = SC.score_with_model(aligned, model, keep=("id", "is_valid", "reasons"), threshold=threshold)
        decided = [c for c in out.columns if c not in ("id", "is_valid", "reasons")]
        return out.withColumns({c: F.when(F.col("is_valid") == 1, F.col(c)) for c in decided})   # rejected: no decision

    if args.stream and args.rejects:
        q = start_scoring_service(spark, args.requests, args.out, args.rejects, transform, delay=args.duplicate_delay)
        q.awaitTermination()
        return {"status": "stream finished", "output": args.out, "rejects": args.rejects}
    if args.stream:
        q = start_scoring_stream(spark, args.requests, args.out, {}, 0.0, transform=transform)
        q.awaitTermination()
        return {"status": "stream finished"}
    transform(spark.read.schema(REQUEST_SCHEMA).parquet(args.requests)).write.mode("overwrite").parquet(args.out)
    return {"status": "scored", "output": args.out}


def cmd_activate(args) -> dict:
    from riskmart.operators import registry as REG

    REG.activate(_spark(), args.models, args.version)
    return {"status": "active", "version": args.version}


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="riskmart")
    sub = p.add_subparsers(dest="cmd", required=True)

    def common(sp, raw=True):
        if raw:
            sp.add_argument("--raw", required=True)
            sp.add_argument("--fmt", default="parquet", choices=["parquet", "csv"])
        sp.add_argument("--config")
        sp.add_argument("--skip-validation", action="store_true",
                        help="skip the table checks (minimum row counts assume the full data set)")

    sp = sub.add_parser("build-features"); common(sp); sp.add_argument("--out", required=True)
    sp.add_argument("--force", action="store_true"); sp.set_defaults(fn=cmd_build)
    sp = sub.add_parser("validate"); common(sp); sp.set_defaults(fn=cmd_validate)
    sp = sub.add_parser("train"); common(sp); sp.add_argument("--models", required=True)
    sp.add_argument("--version", default="v2"); sp.set_defaults(fn=cmd_train)
    sp = sub.add_parser("tune"); common(sp); sp.add_argument("--out", required=True)
    sp.add_argument("--family", choices=["xgboost", "lightgbm"], help="adaptive search of a booster family with pruning")
    sp.add_argument("--trials", type=int, default=100); sp.add_argument("--timeout", type=float, default=3600.0)
    sp.set_defaults(fn=cmd_tune)
    sp = sub.add_parser("explain"); common(sp); sp.add_argument("--models", required=True)
    sp.add_argument("--out", required=True); sp.set_defaults(fn=cmd_explain)
    sp = sub.add_parser("score"); common(sp, raw=False); sp.add_argument("--requests", required=True)
    sp.add_argument("--out", required=True); sp.add_argument("--models", required=True)
    sp.add_argument("--version", help="model version (default: the active one)")
    sp.add_argument("--stream", action="store_true")
    sp.add_argument("--rejects", help="with --stream: folder of the rejected requests; repeated request ids are scored once")
    sp.add_argument("--duplicate-delay", default="1 hour", help="for how long a request id is remembered")
    sp.set_defaults(fn=cmd_score)
    sp = sub.add_parser("activate"); sp.add_argument("--models", required=True); sp.add_argument("--version", required=True)
    sp.set_defaults(fn=cmd_activate)

    args = p.parse_args(argv)
    print(json.dumps(args.fn(args), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
