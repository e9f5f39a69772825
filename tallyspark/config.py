"""Matching configuration: defaults, partial overrides, validation, and each organization's own as columns.

Where a function takes `config`, it may be one MatchingConfig for all, or settings (org, matching_config): then every
rule reads its organization's values from typed columns, in one plan for all organizations.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names that stored configurations use, where they differ from the fields below. Fixed values.
STORED_NAMES = {
    "paymentMethod": "payment_method", "exactToleranceAbs": "exact_tolerance", "maxRelativeDelta": "max_relative", "exactToleranceDays": "exact_days", "maxDaysAfter": "max_after", "maxDaysBefore": "max_before",
    "semanticLowerBound": "semantic_low", "semanticUpperBound": "semantic_high", "dateWindowDays": "window_days", "merchantSimilarity": "similarity", "maxCandidatesPerReceipt": "max_candidates",
}


@dataclass(frozen=True)
class Weights:
    amount: float = 0.4
    date: float = 0.2
    merchant: float = 0.3
    currency: float = 0.05
    payment_method: float = 0.05


@dataclass(frozen=True)
class Thresholds:
    auto: float = 90
    review: float = 70
    possible: float = 40


@dataclass(frozen=True)
class AmountRule:
    exact_tolerance: float = 0.01
    max_relative: float = 0.05


@dataclass(frozen=True)
class DateRule:
    exact_days: int = 0
    max_after: int = 5
    max_before: int = 2


@dataclass(frozen=True)
class MerchantRule:
    floor: float = 0.35
    semantic_low: float = 0.3
    semantic_high: float = 0.8


@dataclass(frozen=True)
class DuplicateRule:
    window_days: int = 3
    similarity: float = 0.85


@dataclass(frozen=True)
class MatchingConfig:
    weights: Weights = field(default_factory=Weights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    amount: AmountRule = field(default_factory=AmountRule)
    date: DateRule = field(default_factory=DateRule)
    merchant: MerchantRule = field(default_factory=MerchantRule)
    duplicates: DuplicateRule = field(default_factory=DuplicateRule)
    max_candidates: int = 50

    @classmethod
    def from_json(cls, text: str | None) -> MatchingConfig:
        """Partial overrides on the defaults, under the names of this class or of stored configurations; malformed text
        or null gives the defaults, unknown keys are dropped."""
        base = cls()
        try:
            given = json.loads(text) if text else None
        except ValueError:
            return base
        if not isinstance(given, dict):
            return base
        given = {STORED_NAMES.get(k, k): {STORED_NAMES.get(x, x): y for x, y in v.items()} if isinstance(v, dict) else v for k, v in given.items()}
        parts = {}
        for part in fields(base):
            value, old = given.get(part.name), getattr(base, part.name)
            if part.name == "max_candidates":
                parts[part.name] = value if isinstance(value, int) else old
            elif isinstance(value, dict):
                known = {f.name for f in fields(old)}
                parts[part.name] = replace(old, **{k: v for k, v in value.items() if k in known and isinstance(v, (int, float))})
        return replace(base, **parts)

    def problems(self) -> list[str]:
        """What makes the configuration invalid."""
        t = self.thresholds
        found = [] if t.auto >= t.review >= t.possible else ["thresholds must not rise from auto to possible"]
        return found if sum(asdict(self.weights).values()) > 0 else [*found, "weights must not sum to zero"]

    def merged(self, given: dict) -> MatchingConfig:
        """The configuration with the given partial sections; raises where the result is invalid."""
        stored = {STORED_NAMES.get(k, k): v for k, v in given.items()}
        both = {k: {**(asdict(getattr(self, k)) if isinstance(v, dict) else {}), **{STORED_NAMES.get(x, x): y for x, y in v.items()}} if isinstance(v, dict) else v for k, v in stored.items()}
        sections = {f.name: asdict(getattr(self, f.name)) for f in fields(self) if f.name != "max_candidates"} | {"max_candidates": self.max_candidates}
        out = MatchingConfig.from_json(json.dumps(sections | both))
        if found := out.problems():
            raise ValueError("; ".join(found))
        return out


Config = MatchingConfig | DataFrame


def _stored(name: str) -> list[str]:
    """The names that a field may have in stored settings."""
    return [*(k for k, v in STORED_NAMES.items() if v == name), name]


def _schema() -> str:
    base, parts = MatchingConfig(), []
    for part in fields(base):
        kind = "double"
        if part.name != "max_candidates":
            inner = [f"{n}: double" for f in fields(getattr(base, part.name)) for n in _stored(f.name)]
            kind = f"struct<{', '.join(inner)}>"
        parts += [f"{n} {kind}" for n in _stored(part.name)]
    return ", ".join(parts)


def _values(given: Column, names=_stored) -> Column:
    """All values of a configuration, from what is given under `names` of each field or, where that has none, by default."""
    base, sections = MatchingConfig(), []

    def value(default: float, found: list[Column]) -> Column:
        return F.coalesce(*found, F.lit(float(default))).cast("int" if isinstance(default, int) else "double")

    for part in fields(base):
        old = getattr(base, part.name)
        if part.name == "max_candidates":
            sections.append(value(old, [given[n] for n in names(part.name)]).alias(part.name))
            continue
        # thresholds are written as whole numbers, but need not be
        inner = [value(float(d) if part.name == "thresholds" else d, [given[part.name][n] for n in names(f)]).alias(f) for f, d in asdict(old).items()]
        sections.append(F.struct(*inner).alias(part.name))
    return F.struct(*sections)


def _parsed(settings: DataFrame) -> DataFrame:
    return settings.select("org", F.from_json("matching_config", _schema()).alias("given"))


def configurations(settings: DataFrame) -> DataFrame:
    """(org, cfg): each organization's configuration, from settings (org, matching_config), typed and complete. Malformed
    texts, unknown keys and values that are no numbers give way to the defaults."""
    return _parsed(settings).select("org", _values(F.col("given")).alias("cfg"))


#: So many organizations' settings go to the tasks whole.
FEW_SETTINGS = 20000


def with_rules(rows: DataFrame, config: Config) -> tuple[DataFrame, MatchingConfig]:
    """`rows` with what the rules read, and the rules: values, or columns of `cfg`, which is added for settings.

    Settings are counted: cut a costly plan first."""
    if isinstance(config, MatchingConfig):
        return rows, config
    known = configurations(config).withColumnRenamed("cfg", "_cfg")
    # rows of few organizations must not be dealt by these; what is sent whole is bounded
    known = F.broadcast(known) if config.limit(FEW_SETTINGS + 1).count() <= FEW_SETTINGS else known
    # organizations without settings have the defaults, value by value: a whole struct in their place came out as nulls
    joined = rows.join(known, "org", "left").withColumn("cfg", _values(F.col("_cfg"), lambda name: [name])).drop("_cfg")
    base, parts = MatchingConfig(), {}
    for part in fields(base):
        old = getattr(base, part.name)
        names = [] if part.name == "max_candidates" else list(asdict(old))
        parts[part.name] = replace(old, **{f: F.col(f"cfg.{part.name}.{f}") for f in names}) if names else F.col(f"cfg.{part.name}")
    return joined, replace(base, **parts)
