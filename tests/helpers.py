"""What tests share."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(df, con, sql):
    """Equal rows whatever the order; columns by name."""
    cols = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr([r[names.index(c)] for c in cols]) for r in found.fetchall())
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    assert got == want
