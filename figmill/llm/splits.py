"""Splits that keep all records of an article together.

Articles are the connected components of the bipartite graph of records and the DOIs and PMCIDs they name, found by
iterative minimum-label propagation. Articles are then assigned to splits so that record shares and label shares
come near their targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm import common as C
from figmill.sources.tables import Stage

MAX_ROUNDS = 60


def propagate(edges: DataFrame) -> DataFrame:
    """entity, label of an edge table (record, entity): label is the smallest entity of the connected component.

    Every round sends the smallest label from entities to records and back, then jumps to the label of the label, so
    chains close in few rounds. Each round is written to the shared folder and the one before it dropped. Null records
    or entities are no edges; repeated edges count once; an empty table gives an empty one.
    """
    edges = edges.where(F.col("record").isNotNull() & F.col("entity").isNotNull())
    old = Stage(edges.select("entity").distinct().withColumn("label", F.col("entity")).withColumn("was", F.col("entity")))
    for _ in range(MAX_ROUNDS):
        labels = old.df.select("entity", "label")
        of_record = edges.join(labels, "entity").groupBy("record").agg(F.min("label").alias("least"))
        new = edges.join(of_record, "record").groupBy("entity").agg(F.min("least").alias("least"))
        jump = labels.select(F.col("entity").alias("least"), F.col("label").alias("beyond"))
        new = new.join(jump, "least").join(labels.withColumnRenamed("label", "was"), "entity")
        now = Stage(new.select("entity", F.least("least", "beyond").alias("label"), "was"))
        old.drop()
        old = now
        if not now.df.where(F.col("label") != F.col("was")).limit(1).count():
            return now.df.select("entity", "label")
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")


def articles(panels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, label) of each DOI and PMCID, and (label, home_id) of each article: its smallest paper_id as stored.

    Rows are first reduced to the distinct sets of keys, so an article with a third of all rows is one small group.
    """
    sets = panels.select("paper_id", C.row_keys().alias("keys")).where(F.size("keys") > 0)
    sets = Stage(sets.groupBy("keys").agg(F.min("paper_id").alias("home_id"))).df
    edges = Stage(sets.where(F.size("keys") > 1).select(F.array_join("keys", "\n").alias("record"), F.explode("keys").alias("entity"))).df
    linked = propagate(edges)
    alone = sets.where(F.size("keys") == 1).select(F.col("keys")[0].alias("entity"))
    alone = alone.join(linked, "entity", "left_anti").select("entity", F.col("entity").alias("label"))
    labels = Stage(linked.unionByName(alone)).df
    homes = sets.select(F.col("keys")[0].alias("entity"), "home_id").join(labels, "entity")
    return labels, homes.groupBy("label").agg(F.min("home_id").alias("home_id"))


def homes_of(ids: DataFrame, panels: DataFrame) -> DataFrame:
    """prefix, home_id, records: for each distinct text before __fig of ``ids`` the home id of the article it names.

    A text that names an article which panels lacks has no row.
    """
    labels, homes = articles(panels)
    prefixes = ids.select(C.before_fig(F.col("panel_id")).alias("prefix")).where("prefix is not null")
    prefixes = prefixes.groupBy("prefix").agg(F.count("*").alias("records"))
    keyed = prefixes.withColumn("entity", F.coalesce(C.paper_key(F.col("prefix")), F.concat(F.lit("r:"), F.col("prefix"))))
    return keyed.join(labels, "entity").join(homes, "label").select("prefix", "home_id", "records")


def misplaced(samples: DataFrame, panels: DataFrame) -> DataFrame:
    """panel_id, paper_id of each record whose panel_id is not under its article's home id, with that home id."""
    ids = C.records(samples, [])
    found = Stage(homes_of(ids, panels).where(F.col("prefix") != F.col("home_id"))).df
    ids = ids.withColumn("prefix", C.before_fig(F.col("panel_id")))
    return C.skew_lookup(ids, found, "prefix", "records").select("panel_id", F.col("home_id").alias("paper_id"))


#: Small articles are hashed into so many units; articles above 1 / UNITS of all records are units of their own.
#: The table of units and labels is all that one task sees, whatever the input.
UNITS = 2048
PASSES = 8


def _assign(shares: list[tuple[str, float]]):
    """Greedy assignment of units, largest first, to the split that lessens the squared label deviation most."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        wide = pdf.pivot_table(index="unit", columns="stratum", values="n", aggfunc="sum", fill_value=0)
        wide = wide.loc[sorted(wide.index, key=lambda u: (-wide.loc[u].sum(), u))]
        counts, total = wide.to_numpy(float), wide.to_numpy(float).sum(axis=0)
        share = np.array([s for _, s in shares])
        scale = 1 / np.maximum(total, 1)
        have, size, all_rows = np.zeros((len(share), counts.shape[1])), np.zeros(len(share)), counts.sum()

        def best(row) -> int:
            gap, n = have - share[:, None] * total, row.sum()
            cost = (((gap + row) ** 2 - gap**2) * scale).sum(axis=1)
            cost += len(total) * ((size + n - share * all_rows) ** 2 - (size - share * all_rows) ** 2) / max(all_rows, 1)
            return int(np.argmin(cost))

        at = np.full(len(counts), -1)
        for _ in range(PASSES):  # the first assigns, the others move what now fits better elsewhere
            before = at.copy()
            for i, row in enumerate(counts):
                if at[i] >= 0:
                    have[at[i]] -= row
                    size[at[i]] -= row.sum()
                at[i] = best(row)
                have[at[i]] += row
                size[at[i]] += row.sum()
            if (at == before).all():
                break
        chosen = [shares[k][0] for k in at]
        return pd.DataFrame({"unit": list(wide.index), "split_name": chosen})

    return run


def split_groups(members: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """group, split_name of a table (group, stratum, n), n records each: no group is divided between splits.

    targets: split names and shares, of sum 1. Ties fall to the split named first. A null stratum is a stratum of its
    own; rows with a null group are dropped (they belong to no group); an empty table gives an empty one.
    """
    if not targets:
        raise ValueError("no splits")
    sized = members.where("group is not null").groupBy("group", F.coalesce("stratum", F.lit("")).alias("stratum")).agg(F.sum("n").alias("n"))
    sized = Stage(sized).df
    totals = sized.groupBy("group").agg(F.sum("n").alias("size"))
    rows = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    small = F.format_string("~%04d", F.pmod(F.xxhash64("group"), F.lit(UNITS)))
    units = Stage(totals.select("group", F.when(F.col("size") * UNITS > rows, F.concat(F.lit("="), F.col("group"))).otherwise(small).alias("unit"))).df
    table = sized.join(units, "group").groupBy("unit", "stratum").agg(F.sum("n").alias("n"))
    chosen = table.groupBy().applyInPandas(_assign(targets), "unit string, split_name string")
    return units.join(Stage(chosen).df, "unit").select("group", "split_name")


def article_splits(panels: DataFrame, samples: DataFrame, mix: DataFrame, targets: DataFrame) -> DataFrame:
    """panel_id, split_name of every panel of panels and every record of samples; an article is in one split only.

    An article that panels lacks is a group by the DOI or PMCID that the text before __fig names, in whatever form; a
    panel_id that names neither is a group of its own prefix.
    """
    shares = [(r["split_name"], r["share_permille"] / 1000) for r in targets.orderBy("split_name").collect()]
    subject = C.known_names(mix, "subject")
    ids = panels.select(C.panel_id().alias("panel_id")).where("panel_id is not null").select("panel_id", F.lit(None).cast("string").alias("stratum"))
    recs = C.records(samples, ["subject"]).select("panel_id", C.to_known(F.col("subject"), subject).alias("stratum"))
    both = Stage(ids.unionByName(recs).groupBy("panel_id").agg(F.max("stratum").alias("stratum"))).df
    homes = homes_of(both, panels)
    prefix = F.coalesce(C.before_fig(F.col("panel_id")), F.col("panel_id"))
    counts = both.select(prefix.alias("prefix"), "stratum").groupBy("prefix", "stratum").agg(F.count("*").alias("n"))
    group = F.coalesce("home_id", C.paper_key(F.col("prefix")), F.col("prefix"))
    groups = Stage(counts.join(homes.select("prefix", "home_id"), "prefix", "left").withColumn("group", group)).df
    named = split_groups(groups.select("group", "stratum", "n"), shares)
    by_prefix = groups.groupBy("prefix", "group").agg(F.sum("n").alias("records")).join(named, "group").select("prefix", "split_name", "records")
    return C.skew_lookup(both.select("panel_id", prefix.alias("prefix")), Stage(by_prefix).df, "prefix", "records").select("panel_id", "split_name")


def split_report(assigned: DataFrame, panels: DataFrame, targets: DataFrame) -> DataFrame:
    """split_name, share_permille, records, gap_permille, torn of each split of ``targets``.

    gap_permille is how far the split's share of all records is from its target. torn counts the articles of the split that
    are in another one, too: they are found anew from the keys that panel_ids name, not from the groups that were assigned.
    """
    labels, _ = articles(panels)
    prefix = F.coalesce(C.before_fig(F.col("panel_id")), F.col("panel_id"))
    entity = F.coalesce(C.paper_key(prefix), F.concat(F.lit("r:"), prefix))
    mine = assigned.groupBy(entity.alias("entity"), "split_name").agg(F.count("*").alias("n")).join(labels, "entity", "left")
    mine = mine.groupBy(F.coalesce("label", "entity").alias("article"), "split_name").agg(F.sum("n").alias("n"))
    in_splits = mine.groupBy("article").agg(F.collect_list(F.struct("split_name", "n")).alias("each"))  # at most one entry a split
    per = in_splits.select(F.inline("each"), (F.size("each") > 1).alias("torn")).groupBy("split_name").agg(F.sum("n").alias("records"), F.count_if("torn").alias("torn"))
    total = per.agg(F.sum("records").alias("all"))
    report = targets.select("split_name", "share_permille").join(per, "split_name", "left").join(F.broadcast(total))
    records = F.coalesce("records", F.lit(0))
    return report.select("split_name", "share_permille", records.alias("records"), (records * 1000 / F.col("all") - F.col("share_permille")).alias("gap_permille"), F.coalesce("torn", F.lit(0)).alias("torn"))
