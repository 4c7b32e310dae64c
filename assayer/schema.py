"""Schema documents: constituents, expected values, invalid combinations and ablated variants. All of it is driver-side and small."""

from __future__ import annotations

import copy
import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FIXED = ("capability", "systematizedConcept", "deploymentPopulation", "contextualConstraints", "systematizedInstance")
POPULATION = "intended_deployment_population"


@dataclass
class Schema:
    """A parsed schema document; a nested group gives its leaves' names, not its own."""

    document: dict
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    values: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def parse(cls, document: dict | str) -> Schema:
        doc = json.loads(document) if isinstance(document, str) else document
        out = cls(doc)
        for name, leaf in leaves(doc.get("constituents") or {}):
            (out.required if leaf.get("required") else out.optional).append(name)
            raw = leaf.get("value")
            given = [] if raw is None else raw if isinstance(raw, list) else [raw]
            out.values[name] = [atom for v in given for atom in atoms(v)]
        return out

    @property
    def columns(self) -> list[str]:
        return [name for name, _ in leaves(self.document.get("constituents") or {})]

    @property
    def seeds(self) -> list[str]:
        """The seed texts that are not blank."""
        return [str(s) for s in self.document.get("seedExamples") or [] if s is not None and str(s).strip()]

    @property
    def population(self) -> str | None:
        value = (self.document.get("fixedFields") or {}).get("deploymentPopulation")
        if isinstance(value, list):
            value = value[0] if len(value) == 1 else None
        return str(value).strip() or None if value is not None else None

    def invalid_combinations(self) -> list[tuple[str, ...]]:
        """Rules of full arity over the columns; rules of another arity are left out."""
        fixed = self.document.get("fixedFields") or {}
        raw = self.document.get("invalidCombinations") or self.document.get("invalid_combinations") or fixed.get("invalidCombinations") or []
        columns = self.columns
        rows = ([r.get(c) for c in columns] if isinstance(r, dict) else list(r) for r in raw)
        return [tuple(map(str, r)) for r in rows if len(r) == len(columns) and None not in r]

    def expected(self, spark: SparkSession) -> DataFrame:
        rows = [(c, i, v) for c, vs in self.values.items() for i, v in enumerate(dict.fromkeys(vs))]
        return spark.createDataFrame(rows, "col string, ordinal int, value string")

    def require(self, df: DataFrame) -> DataFrame:
        """df with trimmed column names, missing optional columns as null and the population filled in; ValueError if required ones lack."""
        df = df.toDF(*(c.strip() for c in df.columns))
        if missing := [c for c in self.required if c not in df.columns]:
            raise ValueError(f"required columns are missing: {missing}")
        for c in self.optional:
            if c not in df.columns:
                df = df.selectExpr("*", f"cast(null as string) as `{c}`")
        if POPULATION not in df.columns:
            if self.population is None:
                raise ValueError(f"column {POPULATION} is missing and the schema names no single population")
            from pyspark.sql import functions as F

            df = df.withColumn(POPULATION, F.lit(self.population))
        return df


def atoms(value: object) -> list[str]:
    return [p.strip() for p in str(value).split(";") if p.strip()]


def leaves(constituents: dict) -> list[tuple[str, dict]]:
    out: list[tuple[str, dict]] = []
    for name, node in constituents.items():
        out += leaves(node["subConstituents"]) if isinstance(node, dict) and "subConstituents" in node else [(name, node)]
    return out


def parse_exclusions(raw: str | None) -> list[list[str]] | None:
    """A JSON list of lists of values; blanks go, empty rules are refused (they would match everything)."""
    if not raw or not raw.strip():
        return None
    rules = json.loads(raw)
    if not isinstance(rules, list) or not all(isinstance(r, list) for r in rules):
        raise ValueError("exclusions must be a list of lists")
    out = [[str(v).strip() for v in r if str(v).strip()] for r in rules]
    if not all(out):
        raise ValueError("an exclusion rule has no values")
    return out or None


def parse_indices(raw: str) -> list[int]:
    """'[0, 2]' or '0,2' as whole numbers from 0; ValueError otherwise."""
    text = raw.strip()
    items = json.loads(text) if text.startswith("[") else [p for p in text.split(",") if p.strip()]
    out = [int(str(i).strip()) for i in items]
    if any(i < 0 for i in out):
        raise ValueError("indices start at 0")
    return out


def without(document: dict, fixed: set[str], constituents: set[str], seeds: bool) -> dict:
    """An ablated copy: fixed fields dropped, constituents blanked, seeds dropped."""
    doc = copy.deepcopy(document)
    for f in fixed:
        (doc.get("fixedFields") or {}).pop(f, None)
    for name, leaf in leaves(doc.get("constituents") or {}):
        if name in constituents:
            leaf["value"] = []
    if seeds:
        doc["seedExamples"] = []
    return doc


def seed_combinations(n_seeds: int, sizes: list[int], most: int, seed: int = 42) -> list[tuple[int, ...]]:
    """Per size all combinations of seeds, or `most` of them drawn by index without listing them all; size 0 is the empty one."""
    import math
    import random

    rng, out = random.Random(seed), []
    for s in sizes:
        total = math.comb(n_seeds, s)
        if total <= most:
            out += list(itertools.combinations(range(n_seeds), s))
            continue
        for rank in sorted(rng.sample(range(total), most)):
            combo, at = [], 0
            for left in range(s, 0, -1):
                while rank >= (here := math.comb(n_seeds - at - 1, left - 1)):
                    rank, at = rank - here, at + 1
                combo.append(at)
                at += 1
            out.append(tuple(combo))
    return out
