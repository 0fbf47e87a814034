import os

import pytest

from rookery.sources import tables as T


class Conf:
    def get(self, key, default=None):
        return None


class Fake:
    """A session on a cluster without a shared folder."""

    conf = Conf()

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            isEmpty = staticmethod(lambda: True)

                        return Empty

                return Sc


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_no_machine_local_folder_on_a_cluster(master):
    Fake.sparkContext.master = master
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        T.shared_folder(Fake)


def test_folders_are_released(spark):
    df = T.written(spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string"), "some", by=["s"])
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a"), (2, "b")]
    kept = [p.removeprefix("file:") for p in T._FOLDERS]
    assert kept and all(os.path.isdir(p) for p in kept)
    assert T.release(spark) == len(kept) and not any(os.path.exists(p) for p in kept)
