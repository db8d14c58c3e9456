"""The report of a run: what every stage read, wrote and lost, and what was minted.

Counts are observed while the tables are written, so the report scans no table again. It is
itself two small tables, a row for each stage and a row for each count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.constants import MIN_PATHWAY_GENES, SNAPSHOT
from tessera.operators.build import Built

# fixed values: notes of the sources and stages
LICENCES = {
    "sider": "Academic/non-commercial use; MedDRA terms under MSSO licence.",
    "chembl": "ChEMBL CC BY-SA 3.0; PubChem public domain.",
    "opentargets": "CC0 1.0 (public domain).",
    "reactome": "CC0 1.0 (public domain).",
}
ABSENT = "raw inputs not present"
UNRESOLVED = "seed ids not resolvable in Open Targets: "
DERIVED = "DERIVED: Open Targets disease genes x Reactome gene->pathway"

#: The build that mints the ids of an entity.
ENTITIES = {
    "drug": "drugs",
    "side_effect": "drug_side_effects",
    "disease": "diseases",
    "gene": "disease_genes",
    "target": "targets",
    "pathway": "disease_pathways",
}


@dataclass
class Stage:
    name: str
    available: bool = True
    note: str = ""


def source_stages(ready: Sequence[str]) -> list[Stage]:
    """The snapshot, and one stage for each source: its licence, or that it is absent."""
    stages = [Stage("snapshot", note=SNAPSHOT)]
    for source, licence in LICENCES.items():
        there = source in ready
        stages.append(Stage(f"download:{source}", there, licence if there else ABSENT))
    return stages


def build_stages(
    plan: Sequence[tuple[str, bool, str]], made: Mapping[str, Built], support: Observation
) -> list[Stage]:
    """One stage for each table of the coverage ``plan``; those not built say what they lack."""
    stages = []
    for table, built, note in plan:
        if built and table == "disease_pathways" and table in made:
            n = support.get
            note = (
                f"{DERIVED} | {n['n_candidate_pairs']} candidate (disease,pathway) pairs; "
                f"{n['n_dropped']} dropped for < {MIN_PATHWAY_GENES} supporting genes"
            )
        stages.append(Stage(f"build:{table}", built, note))
    return stages


class RunReport:
    def __init__(
        self,
        spark: SparkSession,
        stages: list[Stage],
        built: Mapping[str, Built],
        minted: Mapping[str, Observation],
        ledger: DataFrame | None,
        unresolved: DataFrame | None = None,
    ) -> None:
        """``unresolved`` has (seq, ontology_id) of the seeds without a payload."""
        self.spark, self._stages, self.built, self.minted = spark, stages, built, minted
        self.ledger, self.unresolved = ledger, unresolved

    def stages(self) -> DataFrame:
        """(position, stage, available, note, input_rows, output_rows, n_rejected): rows that
        came to a table's contract, rows of the table, and all that its stage refused."""
        rows = []
        for i, s in enumerate(self._stages, 1):
            b = self.built.get(s.name.removeprefix("build:"))
            came, left = (b.input.get["n"], b.output.get["n"]) if b else (0, 0)
            rows.append((i, s.name, s.available, s.note, came, left))
        kinds = "position int, stage string, available boolean, note string, input_rows long, output_rows long"
        table = self.spark.createDataFrame(rows, kinds)
        refused = F.coalesce("n", F.lit(0)).alias("n_rejected")
        if self.ledger is None:
            return table.select("*", F.lit(0).cast("long").alias("n_rejected"))
        lost = self.ledger.groupBy("stage").agg(F.sum("n_rejected").alias("n"))
        table = table.join(lost, "stage", "left").select(*table.columns, refused)
        return table if self.unresolved is None else self._with_seeds(table)

    def _with_seeds(self, table: DataFrame) -> DataFrame:
        """The note of the diseases names the wanted ids that were not found, in their order."""
        first = self.unresolved.groupBy("ontology_id").agg(F.min("seq").alias("seq"))
        names = F.transform(F.sort_array(F.collect_list(F.struct("seq", "ontology_id"))), lambda s: s["ontology_id"])
        told = first.groupBy(F.lit("build:diseases").alias("stage")).agg(
            F.concat(F.lit(UNRESOLVED), F.array_join(names, ", ")).alias("_told")
        )
        joined = table.join(told, "stage", "left")
        return joined.withColumn("note", F.coalesce("_told", "note")).select(*table.columns)

    def counts(self) -> DataFrame:
        """(kind, name, n): rows of each dataset, ids of each entity."""
        rows = [("dataset", name, b.output.get["n"]) for name, b in self.built.items()]
        rows += [("entity", name, seen.get["n"]) for name, seen in self.minted.items()]
        return self.spark.createDataFrame(rows, "kind string, name string, n long")
