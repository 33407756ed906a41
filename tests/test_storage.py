import os
from types import SimpleNamespace

import pytest

from tailframe.plans import storage


def folder_of(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_a_scope_deletes_what_is_stored_in_it(spark):
    outer = storage.stored(spark.range(3), "t")
    with storage.scope(spark):
        inner, kept = storage.stored(outer, "t"), storage.stored(outer, "t", keep=True)
        paths = [folder_of(x) for x in (outer, inner, kept)]
        with pytest.raises(ZeroDivisionError), storage.scope(spark):
            lost = folder_of(storage.stored(outer, "t"))
            raise ZeroDivisionError
        assert not os.path.exists(lost)
        assert all(map(os.path.exists, paths))
    assert [os.path.exists(p) for p in paths] == [True, False, True]
    assert kept.count() == 3


def test_a_memo_computes_once_until_it_is_old(spark):
    made = []

    def make():
        made.append(storage.stored(spark.range(len(made) + 1), "part"))
        return made[-1]

    memo = storage.Memo(spark, seconds=900)
    one = memo.get(("load", "A"), make)
    part, path = folder_of(made[0]), folder_of(one)
    assert memo.get(("load", "A"), make).count() == one.count() == 1
    assert len(made) == 1
    assert (os.path.exists(part), os.path.exists(path)) == (False, True)
    memo.seconds = -1
    assert memo.get(("load", "A"), make).count() == 2
    assert not os.path.exists(path)
    memo.clear()
    assert not memo.held


def test_executors_need_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)
