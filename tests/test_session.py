import os
from types import SimpleNamespace

import pytest

from orewright import session


def _fake(master, folder=None):
    conf = SimpleNamespace(get=lambda *_: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_no_machine_local_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(_fake(master))
        assert session.shared_dir(_fake(master, "file:///shared/")) == "file:///shared"
    for master in ("local", "local[4]", "local[*]"):
        assert session.shared_dir(_fake(master)).startswith("file:///")


def test_tables_can_be_discarded(spark):
    kept, gone = (session.materialize(spark.range(9), name) for name in ("kept", "gone"))
    paths = [df._orewright_path.removeprefix("file://") for df in (kept, gone)]
    assert all(map(os.path.isdir, paths))
    session.discard(gone, spark.range(3))
    assert os.path.isdir(paths[0]) and not os.path.exists(paths[1]) and kept.count() == 9


def test_parted_table(spark):
    df = session.materialize(spark.range(20).selectExpr("id", "cast(id % 3 as int) as part"), "parted", ["part"])
    assert sorted(r.id for r in df.filter("part = 1").collect()) == list(range(1, 20, 3))
