"""Feature roles derived from column names.

Naming convention of the wide tables: ``<prefix>_<family>_<nn>[_cat|_bin]``.
Roles are matched on ``_``-separated tokens, never raw substrings, so a helper
column such as ``index`` can never fall into family ``ind``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the naming convention.
FAMILIES = ("ind", "reg", "car", "calc")
CAT_TOKEN = "cat"
BIN_TOKEN = "bin"
KEY_COLS = ("id", "split", "target")


def tokens(name: str) -> list[str]:
    return name.split("_")


@dataclass(frozen=True)
class FeatureRoles:
    """Column lists by role for one wide table."""

    columns: tuple[str, ...]
    dtypes: dict = field(default_factory=dict, compare=False)
    keys: tuple[str, ...] = KEY_COLS

    @classmethod
    def of(cls, df: DataFrame, keys: tuple[str, ...] = KEY_COLS) -> "FeatureRoles":
        return cls(tuple(df.columns), {f.name: f.dataType for f in df.schema.fields}, keys)

    @property
    def features(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys]

    def family(self, fam: str) -> list[str]:
        return [c for c in self.features if fam in tokens(c)]

    @property
    def cat(self) -> list[str]:
        return [c for c in self.features if CAT_TOKEN in tokens(c) and "count" not in tokens(c)]

    @property
    def bin(self) -> list[str]:
        return [c for c in self.features if BIN_TOKEN in tokens(c)]

    @property
    def num(self) -> list[str]:
        """Numeric block: not categorical and not ``calc``."""
        return [c for c in self.features if CAT_TOKEN not in tokens(c) and "calc" not in tokens(c)]

    @property
    def num_with_calc(self) -> list[str]:
        return [c for c in self.features if CAT_TOKEN not in tokens(c)]

    @property
    def generated(self) -> list[str]:
        return [c for c in self.features if "inter" in tokens(c)]

    def level(self, name: str) -> str:
        """binary / nominal / interval / ordinal, as the metadata helper of the reference defines it."""
        tk = tokens(name)
        if BIN_TOKEN in tk or name == "target":
            return "binary"
        if CAT_TOKEN in tk or name == "id":
            return "nominal"
        dt = self.dtypes.get(name)
        if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
            return "interval"
        return "ordinal"
