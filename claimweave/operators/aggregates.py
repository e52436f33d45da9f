"""Grouped operators. Groups of unbounded size are counted, hashed or kept as rows, never gathered into one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.identity import multiset_digest, multiset_hash, sha256
from claimweave.functions.vocab import DIRECTIONS, POLARITY, POSITIVE_STATUSES
from claimweave.operators.filters import lookup
from claimweave.operators.graph import connected_components
from claimweave.session import cut_lineage


def merge_claims(claims: DataFrame, identity: list[str], order: str) -> DataFrame:
    """One row per claim identity: the first evidence and origin win, supports are counted once each."""
    return claims.groupBy(*identity).agg(
        F.min_by(F.struct(order, "origin"), F.col(order)).alias("first"), F.count_distinct(order).alias("supports")
    ).select(*identity, F.col(f"first.{order}").alias("first_evidence"), F.col("first.origin").alias("origin"), "supports")


def claim_supports(claims: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The support rows of merged claims."""
    return claims.select(*identity, F.col(order).alias("support")).distinct()


def disagreements(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets whose members differ in polarity or in direction; other statuses and directions do not take part."""
    direction = F.when(F.col("effect_direction").isin(*DIRECTIONS), F.col("effect_direction"))
    polarity = lookup(POLARITY, F.col("statement_status"))
    # Minimum and maximum differ exactly when there are two values, at constant cost per group.
    out = claims.groupBy(*keys).agg(
        F.min(polarity).alias("p0"), F.max(polarity).alias("p1"), F.min(direction).alias("d0"),
        F.max(direction).alias("d1"), F.count("*").alias("members"))
    return out.filter("p0 <> p1 or d0 <> d1").select(
        *keys, "members", F.coalesce(F.expr("p0 <> p1"), F.lit(False)).alias("polarity_differs"),
        F.coalesce(F.expr("d0 <> d1"), F.lit(False)).alias("direction_differs"))


def profile_terms(claims: DataFrame) -> DataFrame:
    """(subject, object, positives, negated, open): direct terms with support counts; a term both asserted and negated is open.

    ``claims`` needs an ``eligible`` flag. Negated rows count whether or not they are eligible.
    """
    positive = F.col("statement_status").isin(*POSITIVE_STATUSES) & F.col("eligible")
    negated = F.col("statement_status") == "negated"
    rows = claims.groupBy("subject", "object").agg(
        F.count_if(positive).alias("positives"), F.count_if(negated).alias("negated"))
    return rows.withColumn("open", (F.col("positives") > 0) & (F.col("negated") > 0))


def profiles(terms: DataFrame) -> DataFrame:
    """Per subject: direct terms, supporting rows and open disagreements."""
    return terms.groupBy("subject").agg(
        F.count_if(F.col("positives") > 0).alias("direct_terms"), F.sum("positives").alias("assertions"),
        F.count_if("open").alias("open_disagreements"))


def analytic_inputs(claims: DataFrame, flags: DataFrame, accepted_exact: DataFrame) -> DataFrame:
    """Claims with ``eligible``: no unresolved conflict, no undisposed opposition, positive validity, accepted mapping.

    ``flags``: (claim, in_unresolved_conflict, in_usable_conflict, opposed, non_positive), pre-aggregated per claim;
    ``accepted_exact``: (subject, mapped_id).
    """
    accepted = accepted_exact.select("subject", "mapped_id").distinct().withColumn("accepted", F.lit(True))
    j = claims.join(flags, "claim", "left").join(accepted, ["subject", "mapped_id"], "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    needs_mapping = (F.col("origin") == "source_adapter") & (F.col("predicate") == "has_phenotype")
    ok = (
        ~flag("in_unresolved_conflict") & ~(flag("opposed") & ~flag("in_usable_conflict")) & ~flag("non_positive")
        & (~needs_mapping | flag("accepted"))
    )
    return j.withColumn("eligible", ok).drop("accepted")


def family_key(reference: Column, family: Column, source: Column) -> Column:
    """What counts as one publication: its reference, else its family, else the source itself."""
    def some(c: Column) -> Column:
        return F.when(F.length(c) > 0, c)

    return F.coalesce(F.concat(F.lit("ref:"), some(reference)), some(family), F.concat(F.lit("source:"), source))


def independent_publications(rows: DataFrame, per: list[str]) -> DataFrame:
    """Per group: families counted once when they share a cohort, directly or through others.

    ``rows``: (*per, family, cohort); cohort may be null. Families and cohorts form a two-sided graph whose components
    are the independent publications.
    """
    group = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in per])
    named = cut_lineage(rows.select(
        *per, F.concat(group, F.lit("\u0001f:"), "family").alias("family"),
        F.when(F.col("cohort").isNotNull(), F.concat(group, F.lit("\u0001c:"), "cohort")).alias("cohort")).distinct(), "families")
    links = named.filter("cohort is not null").select(F.col("family").alias("a"), F.col("cohort").alias("b"))
    parts = connected_components(links)
    placed = named.select(*per, "family").distinct().join(parts, F.col("family") == F.col("node"), "left")
    return placed.groupBy(*per).agg(
        F.count("*").alias("families"), F.count_distinct(F.coalesce("component", "family")).alias("independent"))


def effect_facet(contexts: DataFrame) -> DataFrame:
    """(effect, members) over known effects only."""
    return contexts.filter("effect is not null and effect <> 'unknown'").groupBy("effect").agg(
        F.count_distinct("context").alias("members"), F.min("context").alias("first_member"))


def effect_members(contexts: DataFrame) -> DataFrame:
    """(effect, context): the members behind ``effect_facet``."""
    return contexts.filter("effect is not null and effect <> 'unknown'").select("effect", "context").distinct()


def shared_gene_records(members: DataFrame, assertions: DataFrame) -> DataFrame:
    """(gene, assertion): the records behind ``shared_gene_facet``."""
    shared = members.groupBy("gene").agg(F.min("context").alias("lo"), F.max("context").alias("hi")).filter("lo <> hi").select("gene")
    cited = assertions.join(members.select("gene", "disease").distinct(), ["gene", "disease"], "left_semi")
    return cited.join(shared, "gene", "left_semi").select("gene", "assertion").distinct()


def shared_gene_facet(members: DataFrame, assertions: DataFrame) -> DataFrame:
    """Genes of at least two contexts, with the gene-disease records that link the gene to these contexts' diseases.

    ``members``: (context, gene, disease); ``assertions``: (assertion, gene, disease).
    """
    sizes = members.select("context", "gene").distinct().groupBy("gene").agg(F.count("*").alias("members")).filter("members >= 2")
    cited = assertions.join(members.select("gene", "disease").distinct(), ["gene", "disease"], "left_semi")
    records = cited.groupBy("gene").agg(F.count_distinct("assertion").alias("assertions"))
    return sizes.join(records, "gene", "left").select("gene", "members", F.coalesce("assertions", F.lit(0)).alias("assertions"))


def same_set_groups(pairs: DataFrame, owner: str, item: str, least: int = 2) -> DataFrame:
    """Owners grouped by their exact set of items: (set_size, owners, first_owner, set_key).

    A set is recognised by an order-free hash of its distinct items, so no set is gathered.
    """
    return keyed_sets(pairs, owner, item).filter(F.col("set_size") >= least).groupBy("set_key", "set_size").agg(
        F.count("*").alias("owners"), F.min(owner).alias("first_owner"))


def keyed_sets(pairs: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, set_size, set_key): every owner with the key of its set of items."""
    sets = pairs.select(owner, item).distinct().groupBy(owner).agg(*multiset_hash(sha256(F.col(item).cast("string"))))
    return sets.select(owner, F.col("rows").cast("bigint").alias("set_size"), multiset_digest().alias("set_key"))


def same_set_owners(pairs: DataFrame, owner: str, item: str, least: int = 2) -> DataFrame:
    """(first_owner, owner): who belongs to each group of ``same_set_groups``."""
    keyed = keyed_sets(pairs, owner, item).filter(F.col("set_size") >= least)
    first = keyed.groupBy("set_key").agg(F.min(owner).alias("first_owner"))
    return keyed.join(first, "set_key").select("first_owner", owner)


def mechanism_features(pairs: DataFrame) -> DataFrame:
    """(a, b, dimension, comparison, assertion_ids) with one row per dimension; there is no combined score.

    ``pairs`` carries ``effect``, ``gene``, ``process_key``, ``cell`` and ``assay`` of both sides with suffixes _a and _b,
    ``known_a``/``known_b`` saying whether a mechanism definition exists, and ``evidence_a``/``evidence_b``: a map from
    dimension to the ids of the assertions that state it, a bounded list per mechanism. A dimension names the assertions of
    both sides, sorted, each once.
    """
    def text_dimension(name: str) -> Column:
        x, y = F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.when(x.isNull() | y.isNull(), "unknown").when(x == y, "same").otherwise("not_comparable")

    effect = (
        F.when((F.col("effect_a") == "unknown") | (F.col("effect_b") == "unknown"), "unknown")
        .when(F.col("effect_a") == F.col("effect_b"), "same").otherwise("different")
    )
    gene = F.when(F.col("gene_a") == F.col("gene_b"), "same").otherwise("different")
    both = F.col("known_a") & F.col("known_b")

    none = F.array().cast("array<string>")

    def feature(name: str, value: Column) -> Column:
        stated = [F.coalesce(F.try_element_at(f"evidence_{s}", F.lit(name)), none) for s in "ab"]
        return F.struct(F.lit(name).alias("dimension"), value.alias("comparison"), F.array_sort(F.array_union(*stated)).alias("assertion_ids"))

    full = F.array(
        feature("functional_effect", effect), feature("gene", gene),
        feature("affected_process", text_dimension("process_key")),
        feature("cell_or_tissue_context", text_dimension("cell")),
        feature("assay_or_species_context", text_dimension("assay")))
    alone = F.array(feature("functional_effect", F.lit("unknown")))
    return pairs.select("a", "b", F.inline(F.when(both, full).otherwise(alone)))


def ledger_totals(reserves: DataFrame, settles: DataFrame) -> DataFrame:
    """(provider, usd, requests) with a row for every provider and one overall row (provider null).

    Unsettled and uncertain reservations count at the reserved amount, completed ones at the actual amount (else the
    reserved one), unsent ones not at all.
    """
    j = reserves.join(settles, "id", "left")
    usd = (
        F.when(F.col("outcome").isNull() | (F.col("outcome") == "uncertain"), F.col("amount"))
        .when(F.col("outcome") == "completed", F.coalesce("actual", "amount")).otherwise(F.lit(0.0))
    )
    sent = F.coalesce(F.col("outcome") != "not_sent", F.lit(True))
    return j.rollup("provider").agg(F.sum(usd).alias("usd"), F.count_if(sent).alias("requests"))


def distinct_badges(rows: DataFrame, key: str) -> DataFrame:
    """Badges per key in order, each once. Badges come from a short vocabulary, so the list is short."""
    return rows.select(key, "ord", "kind", "label").distinct().groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind", "label"))),
                                 lambda x: F.concat(x["kind"], F.lit("="), x["label"])), "; ").alias("badges"))


def order_statistics(df: DataFrame, value: str, ranks: dict[str, Column], enough: int = 20000) -> dict[str, float]:
    """Exact values at 0-based ranks given as expressions of ``n``.

    Approximate quantiles bracket a rank, rows below the bracket are counted, and only the bracket is searched again
    until it is short or holds a single value. No task sorts the column.
    """
    col = F.col(value)
    base = df.filter(col.isNotNull()).select(value)
    n = base.count()
    one = df.sparkSession.range(1).withColumn("n", F.lit(n))
    wanted = one.select(*[r.cast("bigint").alias(k) for k, r in ranks.items()]).first().asDict()
    out: dict[str, float] = {}
    for name, rank in wanted.items():
        rank, part, size = max(0, min(n - 1, rank)), base, n
        while True:
            if size <= enough:
                out[name] = part.orderBy(value).offset(rank).limit(1).first()[0]
                break
            share, slack = rank / size, 0.02
            lo, hi = part.approxQuantile(value, [max(0.0, share - slack), min(1.0, share + slack)], slack / 2)
            below, inside = part.agg(F.count_if(col < lo), F.count_if(col.between(lo, hi))).first()
            if lo == hi and below <= rank < below + inside:
                out[name] = lo
                break
            if not below <= rank < below + inside:  # the bracket missed: widen by searching everything on one side
                keep = (col < lo) if rank < below else (col > hi)
                shift = 0 if rank < below else below + inside
            else:
                keep, shift = col.between(lo, hi), below
            narrowed = part.filter(keep)
            new_size = narrowed.count()
            if new_size == size:
                out[name] = part.orderBy(value).offset(rank).limit(1).first()[0]
                break
            part, rank, size = narrowed, rank - shift, new_size
    return out


def profile_members(claims: DataFrame) -> DataFrame:
    """(subject, level, kind, id), each once: what stands behind the profiles of both levels.

    ``claims``: (subject, level, statement_status, eligible, evidence, family, mapped_id). Kinds are the evidence of positive
    eligible claims, their publication families and the annotation ids that were mapped; members stay rows, however many.
    """
    positive = claims.filter(F.col("eligible") & F.col("statement_status").isin(*POSITIVE_STATUSES))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("id")) for k, c in (("evidence", "evidence"), ("family", "family"), ("mapped", "mapped_id"))])
    return positive.select("subject", "level", F.inline(kinds)).filter("id IS NOT NULL").distinct()
