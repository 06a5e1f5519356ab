"""Options of a profile run."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields

#: Default where an option is absent, value where it is given bare or is invalid.
DEFAULTS = {"output_path": None, "hll_b": 8, "limit": 1000, "samples": 16, "hash": "xxhash", "categorical": (), "dict_cap": None, "progress": False, "variant_depth": None, "name": "row"}
BARE = {"output_path": "spec.parquet", "hll_b": 8, "limit": 1000, "samples": 16, "hash": "xxhash", "categorical": (), "dict_cap": None, "progress": 1, "variant_depth": None, "name": "row"}


@dataclass(frozen=True)
class Options:
    """``limit``: records read (None: all). ``hll_b``: 4..16 or None (no sketch).
    ``samples``: distinct samples a node keeps, "all", or None (none). ``hash``: xxhash or md5.
    ``categorical``: paths of string columns whose values are kept exhaustively.
    ``variant_depth``: levels of variants that are looked into (None: all); what is cut is flagged as truncated.
    ``dict_cap``: largest dictionary kept per node, flagged as truncated beyond (None: unbounded).
    """

    output_path: str | None = None
    hll_b: int | None = 8
    limit: int | None = 1000
    samples: int | str | None = 16
    hash: str = "xxhash"
    categorical: tuple[str, ...] = ()
    dict_cap: int | None = None
    progress: int | bool = False
    variant_depth: int | None = None
    name: str = "row"

    @property
    def sample_size(self) -> int | None:
        """k of the sampler; None for all values (check ``samples`` for off)."""
        return None if self.samples in ("all", None) else int(self.samples)


def _valid(name: str, value) -> bool:
    if name == "hll_b":
        return value is None or (isinstance(value, int) and not isinstance(value, bool) and 4 <= value <= 16)
    if name == "limit":
        return value is None or (isinstance(value, int) and not isinstance(value, bool) and value >= 0)
    if name == "samples":
        return value in ("all", None) or (isinstance(value, int) and not isinstance(value, bool) and value > 0)
    if name == "hash":
        return value in ("xxhash", "md5")
    if name == "dict_cap":
        return value is None or (isinstance(value, int) and value > 0)
    if name == "variant_depth":
        return value is None or (isinstance(value, int) and value >= 0)
    if name == "categorical":
        return isinstance(value, (tuple, list, set, frozenset))
    if name == "progress":
        return isinstance(value, (int, bool)) and value >= 0
    return value is None or isinstance(value, str)


def make_options(**given) -> Options:
    """Options from keywords; ``True`` means given bare.  Unknown ones are dropped and invalid ones
    take their bare value, both with a warning."""
    known = {f.name for f in fields(Options)}
    out = {}
    for name, value in given.items():
        if name not in known:
            warnings.warn(f"unknown option {name!r} is ignored", stacklevel=2)
        elif value is True and name != "progress":
            out[name] = BARE[name]
        elif value is False and name != "progress":
            out[name] = None if DEFAULTS[name] is not None else DEFAULTS[name]
        elif _valid(name, value):
            out[name] = tuple(value) if name == "categorical" else value
        else:
            warnings.warn(f"invalid value of option {name!r}: {value!r}; using {BARE[name]!r}", stacklevel=2)
            out[name] = BARE[name]
    return Options(**out)
