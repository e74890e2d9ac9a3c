"""The import pipeline end to end: file drop to clean library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.operators import clean, enrich, latest, merge, profile, report, resolve
from rosterlake.session import cut_lineage

NO_DECISIONS = ("pair_id string, account_a string, account_b string, kind string, score double, reasons array<string>, "
                "status string, decided_by string, decided_at timestamp, seq bigint")


@dataclass
class Library:
    """Every layer of a rebuilt library."""

    batches: DataFrame
    staging: DataFrame
    cleaned: DataFrame
    issues: DataFrame
    sources: DataFrame
    snapshots: DataFrame
    accounts: DataFrame
    candidates: DataFrame
    creators: DataFrame
    links: DataFrame

    def profiles(self, batch_ids: list[int] | None = None) -> DataFrame:
        links = self.links if not batch_ids else profile.in_batches(self.links, self.sources, batch_ids)
        return profile.build_profiles(self.accounts, links, self.creators, self.sources)

    def import_reports(self) -> DataFrame:
        return report.import_reports(self.batches, self.issues, self.sources, self.links)


def rebuild(batches: DataFrame, staging: DataFrame, *, decisions: DataFrame | None = None, resolutions: DataFrame | None = None,
            channels: DataFrame | None = None, api_snapshots: DataFrame | None = None) -> Library:
    """Rebuild every layer from staging. Human decisions and API observations are the only state carried over.

    Layers that later ones read several times are written to the checkpoint folder once.
    """
    spark = staging.sparkSession
    cleaned = clean.clean_rows(staging, batches)
    renames = None
    if resolutions is not None:
        cleaned = cut_lineage(resolve.resolve_keys(cleaned, resolutions))
        renames = cleaned.where(F.col("renamed_from").isNotNull()).select(
            F.col("renamed_from").alias("old_id"), F.col("account_id").alias("new_id")).distinct()
        cleaned = cleaned.drop("renamed_from")
    rows = clean.accepted(cleaned)
    snapshots = merge.import_snapshots(rows)
    if api_snapshots is not None:
        snapshots = snapshots.unionByName(api_snapshots, allowMissingColumns=True)
    accounts = latest.current_stats(merge.merge_accounts(rows), snapshots)
    if channels is not None:
        accounts = enrich.fold_channels(accounts, channels)
    accounts = cut_lineage(accounts)
    log = spark.createDataFrame([], NO_DECISIONS) if decisions is None else decisions
    if renames is not None:
        log = resolve.carry_decisions(log, renames)
    candidates = cut_lineage(resolve.apply_decisions(resolve.find_candidates(accounts), log))
    creators, links = resolve.build_creators(accounts, candidates)
    return Library(batches, staging, cleaned, clean.row_issues(cleaned), merge.account_sources(rows), snapshots, accounts,
                   candidates, cut_lineage(creators), cut_lineage(links))
