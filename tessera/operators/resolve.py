"""Resolving a table of free-text queries to entities, all at once.

A query is classified by shape, probes the key index with equi-joins, and takes
its best-priority hit. Equal texts are resolved once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import SUGGESTION_LIMIT
from tessera.functions import ids
from tessera.operators.ordering import left_join_spread, top_per_group

GRAM = 3


# --- key indexes -----------------------------------------------------------------------
def _keys(df: DataFrame, kind: str, key: Column, entity: str, phase: int) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), key.alias("key"), F.col(entity).alias("entity_id"), F.lit(phase).alias("phase")
    ).filter(F.coalesce("key", F.lit("")) != "")


def _index(parts: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("kind", "key", "entity_id").agg(F.min("phase").alias("phase"))


def _known_xrefs(identifiers: DataFrame, entities: DataFrame, entity: str, id_column: str) -> DataFrame:
    known = entities.select(F.col(id_column).alias("internal_id"))
    return identifiers.filter(F.col("entity_type") == entity).join(known, "internal_id", "left_semi")


def read_aliases(raw: DataFrame) -> DataFrame:
    """(alias, ontology): both sides normalised, the last repeat of an alias wins."""
    keyed = raw.select(
        "seq",
        ids.query_text(F.col("alias")).alias("alias"),
        ids.ontology_key(F.col("ontology_id")).alias("ontology"),
    ).filter("alias <> '' and ontology is not null")
    last = F.max(F.struct("seq", "ontology")).alias("l")
    return keyed.groupBy("alias").agg(last).select("alias", F.col("l.ontology").alias("ontology"))


def disease_keys(diseases: DataFrame, identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(kind, key, entity_id, phase) for internal ids, ontology ids, names and aliases."""
    d, x = "disease_id", _known_xrefs(identifiers, diseases, "disease", "disease_id")
    parts = [
        _keys(diseases, "internal", F.col(d), d, 0),
        _keys(diseases, "name", ids.query_text(F.col("disease_name")), d, 0),
        _keys(diseases, "ontology", ids.ontology_key(F.col("ontology_id")), d, 0),
        _keys(x, "ontology", ids.ontology_key(F.col("external_id")), "internal_id", 1),
        _keys(x, "name", ids.query_text(F.col("name")), "internal_id", 1),
    ]
    index = _index(parts)
    targets = index.filter("kind = 'ontology'").select(F.col("key").alias("ontology"), "entity_id")
    named = aliases.join(targets, "ontology").select(
        F.lit("alias").alias("kind"), F.col("alias").alias("key"), "entity_id", F.lit(2).alias("phase")
    )
    return index.unionByName(named)


def unresolved_aliases(aliases: DataFrame, keys: DataFrame) -> DataFrame:
    known = keys.filter("kind = 'ontology'").select(F.col("key").alias("ontology"))
    return aliases.join(known, "ontology", "left_anti").select("alias", "ontology")


def drug_keys(drugs: DataFrame, identifiers: DataFrame) -> DataFrame:
    d, x = "drug_id", _known_xrefs(identifiers, drugs, "drug", "drug_id")

    def external(c: Column) -> Column:
        return F.upper(ids.strip(c))

    parts = [
        _keys(drugs, "internal", F.col(d), d, 0),
        _keys(drugs, "name", ids.query_text(F.col("drug_name")), d, 0),
        _keys(drugs, "external", external(F.col("chembl_id")), d, 0),
        _keys(drugs, "external", external(F.col("canonical_identifier")), d, 0),
        _keys(drugs, "external", external(F.col("pubchem_cid")), d, 0),
        _keys(drugs, "external", external(F.concat(F.lit("CID:"), F.col("pubchem_cid"))), d, 0),
        _keys(x, "external", external(F.col("external_id")), "internal_id", 1),
    ]
    return _index(parts)


# --- probes -----------------------------------------------------------------------------
def _probe(kind: str, key: Column, match_type: str, when: Column) -> Column:
    return F.when(
        when & (F.coalesce(key, F.lit("")) != ""),
        F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(match_type).alias("match_type")),
    )


def _texts(queries: DataFrame, shape: Column) -> DataFrame:
    return (
        queries.select(F.coalesce("query", F.lit("")).alias("text"))
        .distinct()
        .withColumns({"shape": shape, "norm": ids.query_text(F.col("text"))})
    )


def _disease_texts(queries: DataFrame) -> DataFrame:
    t, s, norm = F.col("text"), F.col("shape"), F.col("norm")
    probes = F.array(
        _probe("internal", F.upper(ids.strip(t)), "internal_id", s == "internal_id"),
        _probe("ontology", ids.ontology_key(t), "ontology_id", s == "ontology_id"),
        _probe("name", norm, "exact_name", s == "name"),
        _probe("alias", norm, "alias", s == "name"),
    )
    return _texts(queries, ids.disease_query_kind(t)).withColumn("probes", probes)


def _drug_texts(queries: DataFrame) -> DataFrame:
    t, s, norm = F.col("text"), F.col("shape"), F.col("norm")
    cid = ids.cid_in_query(t)
    outside = s == "external_id"
    probes = F.array(
        _probe("internal", F.upper(ids.strip(t)), "internal_id", s == "internal_id"),
        _probe("external", ids.chembl_in_query(t), "external_id", outside),
        _probe("external", cid, "external_id", outside),
        _probe("external", F.concat(F.lit("CID:"), cid), "external_id", outside),
        _probe("name", norm, "exact_name", s == "name"),
    )
    return _texts(queries, ids.drug_query_kind(t)).withColumn("probes", probes)


def _hits(texts: DataFrame, keys: DataFrame) -> DataFrame:
    probes = texts.select("text", F.posexplode("probes").alias("priority", "p")).filter("p is not null")
    probes = probes.select("text", "priority", "p.*")
    return probes.join(keys.select("kind", "key", "entity_id"), ["kind", "key"])


def _best(hits: DataFrame) -> DataFrame:
    per_key = hits.groupBy("text", "priority", "match_type", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("entity_id")
    )
    best = F.min(F.struct("priority", "match_type", "key", "n", "entity_id")).alias("b")
    return per_key.groupBy("text").agg(best)


def _resolve(queries: DataFrame, texts: DataFrame, keys: DataFrame, names: DataFrame) -> DataFrame:
    best = _best(_hits(texts, keys))
    status = (
        F.when(F.col("shape") == "empty", "empty_query")
        .when(F.col("b.n") == 1, "resolved")
        .when(F.col("b.n") > 1, "ambiguous")
        .otherwise("not_supported")
    )
    answered = texts.join(best, "text", "left").select(
        "text",
        "shape",
        F.col("norm").alias("normalized_query"),
        status.alias("status"),
        F.col("b.match_type").alias("match_type"),
        F.col("b.key").alias("matched_value"),
        F.when(F.col("b.n") == 1, F.col("b.entity_id")).alias("match_id"),
        F.coalesce("b.n", F.lit(0)).alias("n_matches"),
    )
    answered = left_join_spread(answered, names, "match_id", "text")
    return queries.withColumn("text", F.coalesce("query", F.lit(""))).join(answered, "text").drop("text")


def _candidates(queries: DataFrame, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The matches of ambiguous queries, one row each."""
    hits = _hits(texts, keys)
    best = _best(hits).filter("b.n > 1").select("text", "b.priority", "b.key")
    chosen = hits.join(best, ["text", "priority", "key"]).select("text", "match_type", "key", "entity_id")
    return (
        queries.withColumn("text", F.coalesce("query", F.lit("")))
        .join(chosen, "text")
        .select("query_id", "match_type", F.col("key").alias("matched_value"), "entity_id")
    )


def resolve_diseases(queries: DataFrame, keys: DataFrame, diseases: DataFrame) -> DataFrame:
    names = diseases.select(
        F.col("disease_id").alias("match_id"), F.col("disease_name").alias("match_name"), "ontology_id"
    )
    return _resolve(queries, _disease_texts(queries), keys, names)


def ambiguous_diseases(queries: DataFrame, keys: DataFrame) -> DataFrame:
    return _candidates(queries, _disease_texts(queries), keys)


def resolve_drugs(queries: DataFrame, keys: DataFrame, drugs: DataFrame) -> DataFrame:
    names = drugs.select(
        F.col("drug_id").alias("match_id"), F.col("drug_name").alias("match_name"), "chembl_id", "pubchem_cid"
    )
    return _resolve(queries, _drug_texts(queries), keys, names)


def ambiguous_drugs(queries: DataFrame, keys: DataFrame) -> DataFrame:
    return _candidates(queries, _drug_texts(queries), keys)


# --- suggestions ------------------------------------------------------------------------
def _grams(c: Column) -> Column:
    """All distinct substrings of length one to three of a text that is not empty."""
    n = F.length(c)
    sized = [
        F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(c, i, F.lit(k)))).otherwise(
            F.array().cast("array<string>")
        )
        for k in range(1, GRAM + 1)
    ]
    return F.array_distinct(F.concat(*sized))


def _longest_grams(c: Column) -> Column:
    k = F.least(F.length(c), F.lit(GRAM))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substr(c, i, k))
    )


def _rarest(texts: DataFrame, frequency: DataFrame, column: str) -> DataFrame:
    """Each text with its least frequent gram; any gram would do, a rare one is cheap."""
    every = texts.select(column, F.explode(_longest_grams(F.col(column))).alias("gram"))
    scored = every.join(frequency, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return scored.groupBy(column).agg(F.min(F.struct("df", "gram")).alias("r")).select(column, "r.gram")


def _holding(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(norm, key) where the key contains the query, by the query's rarest gram."""
    key_grams = keys.select("key", F.explode(_grams(F.col("key"))).alias("gram"))
    frequency = key_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    met = _rarest(queries, frequency, "norm").join(key_grams, "gram")
    return met.filter(F.contains("key", "norm")).select("norm", "key")


def _held(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(norm, key) where the query contains the key, by the key's rarest gram. A query contains
    no more keys than it has substrings."""
    key_grams = keys.select("key", F.explode(_grams(F.col("key"))).alias("gram"))
    frequency = key_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    query_grams = queries.select("norm", F.explode(_grams(F.col("norm"))).alias("gram"))
    met = _rarest(keys, frequency, "key").join(query_grams, "gram")
    return met.filter(F.contains("norm", "key")).select("norm", "key")


def containing_pairs(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(query, key) where one contains the other, without comparing every pair.

    If a text contains another, it contains each of its grams, the rarest one
    too. So both directions are equi-joins on a gram, checked afterwards.
    """
    return _holding(queries, keys).union(_held(queries, keys)).distinct()


def gram_index(named: DataFrame, grams: DataFrame, limit: int) -> DataFrame:
    """(norm, name, at): the first ``limit`` names whose key contains a text of at most ``GRAM``
    characters. Such a text is a gram itself, so its list is counted and cut once however
    many keys hold it or queries ask for it, and no query meets the keys of its list."""
    lists = named.select(F.explode(_grams(F.col("key"))).alias("norm"), "name", "at").join(grams, "norm", "left_semi")
    firsts = lists.groupBy("norm", "name").agg(F.min("at").alias("at"))
    return top_per_group(firsts, ["norm"], [F.col("at"), F.col("name")], limit)


def suggestions(
    resolved: DataFrame, keys: DataFrame, names: DataFrame, limit: int = SUGGESTION_LIMIT
) -> DataFrame:
    """Up to five names in index order for queries no name matches.

    ``names(entity_id, name)``. A key stands where its first entity stands. Texts of up to
    ``GRAM`` characters read cut lists of names; only longer ones are joined to the keys.
    """
    open_texts = (
        resolved.filter("status = 'not_supported' and shape = 'name' and normalized_query <> ''")
        .select(F.col("normalized_query").alias("norm"))
        .distinct()
    )
    by_name = keys.filter("kind = 'name'").select("key", "entity_id", "phase")
    place = F.struct("phase", "entity_id")
    first = by_name.groupBy("key").agg(F.min(place).alias("key_place"))
    named = (
        by_name.withColumn("own_place", place)
        .join(first, "key")
        .join(names, "entity_id")
        .groupBy("key", "name")
        .agg(F.min(F.struct("key_place", "own_place")).alias("at"))
    )
    # a text unfolds into dozens of grams: a fixed number of parts keeps them from meeting in one task
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = named.repartition(parts, "key")
    known, short = first.select("key").repartition(parts, "key"), F.length("norm") <= GRAM
    pairs = _holding(open_texts.filter(~short), known).union(_held(open_texts, known)).distinct()
    hits = pairs.join(named, "key").select("norm", "name", "at")
    hits = hits.union(gram_index(named, open_texts.filter(short), limit).select("norm", "name", "at"))
    hits = hits.groupBy("norm", "name").agg(F.min("at").alias("at"))
    top = top_per_group(hits, ["norm"], [F.col("at"), F.col("name")], limit, out="place")
    return top.select(F.col("norm").alias("normalized_query"), "place", F.col("name").alias("suggestion"))
