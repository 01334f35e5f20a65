"""Model versions: the active one, damage, and versions of any name."""

import glob
import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer

from riskmart.operators import registry as REG
from riskmart.operators import training as TR


def model(at):
    return PipelineModel(stages=[Bucketizer(splits=[0.0, at, 9.0], inputCol="x", outputCol="y")])


def test_versions_and_damage(spark, scratch):
    for version, at in (("v1", 1.0), ("v2", 2.0), ("2024-06", 3.0)):
        TR.save_artifacts(model(at), ["x"], {"best_model": version}, scratch, version)
    loaded, meta = TR.load_artifacts(scratch)
    assert meta["best_model"] == "2024-06" and meta["threshold"] == 0.5 and loaded.stages[0].getSplits()[1] == 3.0
    assert TR.load_artifacts(scratch, ("none", "v1"))[1]["best_model"] == "v1"
    REG.activate(spark, scratch, "v1")
    assert TR.model_info(scratch)["best_model"] == "v1" and REG.active_version(spark, scratch) == "v1"
    with pytest.raises(FileNotFoundError):
        REG.activate(spark, scratch, "v9")

    REG.activate(spark, scratch, "v2")
    part = next(p for p in glob.glob(f"{scratch}/v2/model/**/part-*", recursive=True) if not p.endswith(".crc"))
    os.remove(part)
    with pytest.raises(REG.DamagedModel, match="missing"):           # never the version before in its place
        TR.load_artifacts(scratch)
    with pytest.raises(REG.DamagedModel):
        TR.load_artifacts(scratch, ("v2", "v1"))
    with pytest.raises(REG.DamagedModel):
        REG.activate(spark, scratch, "v2")
    REG.activate(spark, scratch, "v1")
    assert TR.load_artifacts(scratch)[1]["best_model"] == "v1"
    with open(f"{scratch}/v1/model/extra.bin", "wb") as f:
        f.write(b"x")
    with pytest.raises(REG.DamagedModel, match="not in the manifest"):
        TR.load_artifacts(scratch)
    with pytest.raises(FileNotFoundError):
        TR.load_artifacts(f"{scratch}/nothing")
