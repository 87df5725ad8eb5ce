"""Every registered query against its SQL, on both small scales."""

import pytest

from gradewell.plans import registry

from .oracle import both, connect

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
CON = {f: connect(f) for f in FOLDERS}


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, folder, name):
    got, want = both(spark, CON[folder], folder, name, registry.QUERIES, registry.ORACLES)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert a == b
