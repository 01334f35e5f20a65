"""The command line over raw parquet tables: build, validate, train, explain, score."""

import json

from riskmart.__main__ import main
from riskmart.sources import adapters as A


def test_cli_round_trip(spark, scratch, capsys):
    raw = f"{scratch}/raw"
    for name, df in A.loan_tables(spark, "/root/testdata/sf0.001").items():
        df.write.parquet(f"{raw}/{name}.parquet")
    cfg = f"{scratch}/cfg.yaml"
    with open(cfg, "w") as fh:
        fh.write("cv:\n  n_splits: 3\nrandom_forest:\n  n_estimators: 8\nmodels: [random_forest]\n")

    assert main(["build-features", "--raw", raw, "--out", f"{scratch}/master", "--skip-validation"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["rows"] == 150 and out["columns"] > 140

    main(["validate", "--raw", raw])
    checks = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["checks"]
    assert any(c["check_name"] == "min_rows" and c["passed"] == 0 for c in checks)

    main(["train", "--raw", raw, "--models", f"{scratch}/models", "--config", cfg, "--skip-validation"])
    capsys.readouterr()
    A.adapter(spark, "/root/testdata/sf0.001", "requests").write.parquet(f"{scratch}/requests")
    main(["score", "--requests", f"{scratch}/requests", "--out", f"{scratch}/scored", "--models", f"{scratch}/models"])
    scored = spark.read.parquet(f"{scratch}/scored")
    assert scored.count() == 150
    assert scored.where("is_valid = 1 AND probability IS NULL").count() == 0
    # the same saved pipeline scores a file stream (availableNow trigger, exactly-once file sink)
    main(["score", "--requests", f"{scratch}/requests", "--out", f"{scratch}/scored_stream", "--models",
          f"{scratch}/models", "--stream"])
    streamed = spark.read.parquet(f"{scratch}/scored_stream")
    assert streamed.count() == 150
    assert streamed.where("is_valid = 1 AND probability IS NULL").count() == 0
