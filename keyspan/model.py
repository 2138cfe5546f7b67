"""Small value objects shared by the operators. No data lives here, only descriptions of tables."""

from __future__ import annotations

from dataclasses import dataclass, field


class KeyspanError(ValueError):
    """A request that cannot be carried out as stated."""


class MissingKeyError(KeyspanError):
    """A keyed operation that names only part of the key."""

    def __init__(self, missing: list[str]):
        self.missing = missing
        super().__init__("the complete key is needed; missing " + ", ".join(missing))


@dataclass(frozen=True)
class TableSpec:
    """What a keyed table looks like beyond its Spark schema.

    ``clustering`` holds column names, or ``"name desc"`` for a descending one.
    """

    partition_key: tuple[str, ...]
    clustering: tuple[str, ...] = ()
    static: tuple[str, ...] = ()
    counter: bool = False

    def __post_init__(self):
        object.__setattr__(self, "partition_key", _as_tuple(self.partition_key))
        object.__setattr__(self, "clustering", _as_tuple(self.clustering))
        object.__setattr__(self, "static", _as_tuple(self.static))
        if not self.partition_key:
            raise KeyspanError("a table needs at least one partition key column")

    @property
    def clustering_names(self) -> list[str]:
        return [c.split()[0] for c in self.clustering]

    @property
    def key(self) -> list[str]:
        return [*self.partition_key, *self.clustering_names]

    def require_key(self, columns) -> None:
        have = {c.lower() for c in columns}
        missing = [k for k in self.key if k.lower() not in have]
        if missing:
            raise MissingKeyError(missing)

    def refuse_key(self, columns) -> None:
        keys = {k.lower() for k in self.key}
        bad = [c for c in columns if c.lower() in keys]
        if bad:
            raise KeyspanError("key columns cannot be changed: " + ", ".join(bad))


@dataclass(frozen=True)
class Codec:
    """How text becomes typed values on import."""

    # The default pairs of true and false words.
    boolean_strings: tuple[str, ...] = ("1:0", "Y:N", "T:F", "YES:NO", "TRUE:FALSE")
    boolean_numbers: tuple[float, float] = (1, 0)
    format_numbers: bool = False
    rounding: str = "UNNECESSARY"
    overflow: str = "REJECT"
    timestamp: str | None = None
    date: str | None = None
    time: str | None = None
    unit: str = "MILLISECONDS"
    epoch: str = "1970-01-01T00:00:00Z"
    null_strings: tuple[str, ...] = ()
    binary: str = "BASE64"
    time_zone: str = "UTC"
    locale: str = "en_US"


@dataclass
class ExportReport:
    """What an export read and wrote; ``rows`` is the audited number."""

    rows: int
    splits: int
    path: str
    format: str
    warnings: list[str] = field(default_factory=list)


@dataclass
class LoadReport:
    """Outcome of a bulk load: SUCCESS, WITH_REJECTS, ABORTED or DRY_RUN."""

    status: str
    read: int
    loaded: int
    rejected: int
    rejects_path: str | None = None
    target: str | None = None


def _as_tuple(value) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)
