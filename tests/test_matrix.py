"""Stop on one backend and parallelism, go on with another: nothing lost, nothing twice.

All nine pairs of backends run, each with one change of parallelism (same, up or
down, in turn). KEYFOLD_FULL_MATRIX=1 runs all 27 combinations.
"""

import itertools
import os

import pytest
from conftest import rows

from keyfold.plans.checks import faults
from keyfold.streaming import BACKENDS, ProcessorJob, Setup, savepoint_trial

PAIRS = list(itertools.product(BACKENDS, repeat=2))
SCALES = [(2, 2), (2, 4), (4, 2)]

if os.environ.get("KEYFOLD_FULL_MATRIX"):
    CASES = list(itertools.product(PAIRS, SCALES))
else:
    CASES = [(pair, SCALES[(i + i // 3) % 3]) for i, pair in enumerate(PAIRS)]


@pytest.mark.parametrize("backends,partitions", CASES)
def test_restore(spark, backends, partitions):
    before, after = map(Setup, backends, partitions)
    report = savepoint_trial(spark, before, after, total=2015, keys=100, stop_at=1111)
    assert report.count() == 500
    assert rows(faults(report)) == []


@pytest.mark.parametrize(
    "before,after",
    [
        (Setup("rocksdb", 2, ProcessorJob), Setup("rocksdb_incre", 4, ProcessorJob)),
        (Setup("rocksdb_incre", 4, ProcessorJob), Setup("rocksdb", 2, ProcessorJob)),
        (Setup("hashmap", 2), Setup("rocksdb", 4, ProcessorJob)),
        (Setup("rocksdb", 4, ProcessorJob), Setup("hashmap", 2)),
    ],
)
def test_restore_with_state_variables(spark, before, after):
    report = savepoint_trial(spark, before, after, total=1510, keys=100, stop_at=700, wrapped=False)
    assert rows(faults(report)) == []
