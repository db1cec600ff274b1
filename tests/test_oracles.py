"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomspan.plans import registry

DIR = "/root/testdata/sf0.001"
SOME = "gtf_exon_merge tx_offsets admission_status_counts lift_core lift_cigar lift_tags pairs_cross_tx pair_summary pairs_records pairs_ambiguous pairs_unpaired bedcov_unnamed inject_repeated id_resolve_collisions gene_list_filter flagstat depth_runs bedcov count_genes count_htseq count_fragments coverage_means stats_hist samples_rg index_windows junctions_support junctions_strand bam_roundtrip dedup_stats dedup_mark fixmate sam_text_roundtrip quickcheck calmd_nm lift_revcomp mod_calls tag_surgery".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in ("part", "lineitem", "nation", "region", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = db.execute(registry.oracles()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(cols).collect()) == want


def test_every_query_but_the_digest_has_an_oracle():
    assert set(registry.queries()) - set(registry.oracles()) == {"checksum"}
