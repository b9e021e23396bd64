"""Field mapping: what the target fields are called, typed and keyed by. Metadata only.

A ``SheetMapping`` places every mapped field on the columns of both tables once; keys, plant,
coverage and comparison parts are read off the placed fields.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path


@dataclass(frozen=True)
class FieldMapping:
    """One entry of a mapping file, attributes in the file's order."""

    s4_field: str
    group: str | None = None
    mandatory: bool = False
    is_key_marker: bool = False
    data_type: str | None = None
    length: float | None = None
    decimal: float | None = None
    sheet: str | None = None
    source_table: str | None = None
    source_field: str | None = None
    source_field_note: str | None = None

    @property
    def names(self) -> list[str]:
        """Names its column may bear, the label before the technical one."""
        return [n.upper() for n in (self.s4_field, self.source_field) if n]


def field(label: str, technical: str, data_type: str, length: float | None = None, **flags: bool) -> FieldMapping:
    return FieldMapping(label, data_type=data_type, length=length, source_field=technical, **flags)


# Second key component per sheet, extra comparison key, known type exceptions.
SECONDARY_KEY = {"MARC": "Plant", "MBEW": "Valuation Area"}
EXTRA_KEY = {"MBEW": ["BWTAR"]}
TYPE_EXCEPTIONS = {("MBEW", "ZPLD1"): "mapping rule fills the Date field with cast(STPRS as string)"}

# Mapping used when no mapping file is given.
DEFAULT_MAPPING = {
    "MARC": [
        field("Product Number", "PRODUCT", "Text", 18, mandatory=True, is_key_marker=True),
        field("Plant", "WERKS", "Text", 4, mandatory=True),
        field("MRP Type", "DISMM", "Text", 2, mandatory=True),
        field("Plant Status", "MMSTA", "Text", 2),
        field("Status Valid From", "MMSTD", "Date"),
        field("Purchasing Group", "EKGRP", "Text", 3),
        field("Costing Lot Size", "LOSGR", "Number"),
        field("Minimum Lot Size", "BSTMI", "Number"),
        field("Storage Location", "LGPRO", "Text", 4),
    ],
    "MBEW": [
        field("Product Number", "PRODUCT", "Text", 18, mandatory=True, is_key_marker=True),
        field("Valuation Area", "BWKEY", "Text", 4, mandatory=True),
        field("Valuation Type", "BWTAR", "Text", 10),
        field("Valuation Class", "BKLAS", "Text", 4, mandatory=True),
        field("Standard Price", "STPRS", "Number"),
        field("Planned Price Date 1", "ZPLD1", "Date"),
        field("Planned Price Date 2", "ZPLD2", "Date"),
    ],
}


@dataclass(frozen=True)
class Placed:
    """A mapped field with its column on either side, None where that side has none."""

    field: FieldMapping
    expected: str | None
    actual: str | None

    @property
    def on_both_sides(self) -> bool:
        return self.expected is not None and self.actual is not None

    @property
    def key_part(self) -> tuple[str, str, str]:
        return self.field.names[-1], self.expected, self.actual


class SheetMapping:
    """The mapped fields of one sheet, placed on the columns of an expected and an actual table."""

    def __init__(self, sheet: str, fields: Sequence[FieldMapping], expected: Iterable[str] = (), actual: Iterable[str] = ()):
        self.sheet = sheet
        self._columns = tuple({c.strip().upper(): c for c in side} for side in (expected, actual))
        self.placed = [self._place(f) for f in fields]
        self._by_label = {p.field.s4_field: p for p in self.placed}

    def _place(self, wanted: FieldMapping) -> Placed:
        found = ([side[n] for n in wanted.names if n in side] for side in self._columns)
        return Placed(wanted, *(hits[0] if hits else None for hits in found))

    @cached_property
    def key_labels(self) -> list[str]:
        """Labels of the key: the first marked field, then the sheet's second component."""
        marked = [p.field.s4_field for p in self.placed if p.field.is_key_marker][:1]
        second = [SECONDARY_KEY[self.sheet]] if self.sheet in SECONDARY_KEY else []
        if not marked + second:
            raise ValueError(f"no key fields for sheet {self.sheet!r}")
        return marked + second

    @property
    def plant(self) -> Placed | None:
        """The field that tells the plant: the last key component."""
        return self._by_label.get(self.key_labels[-1])

    @cached_property
    def key_parts(self) -> list[tuple[str, str, str]] | None:
        """(part name, expected column, actual column) of the comparison key; None if a side lacks a part.

        Extra parts of the sheet take part where both sides have them.
        """
        keys = [self._by_label.get(label) for label in self.key_labels]
        if any(p is None or not p.on_both_sides for p in keys):
            return None
        extra = [self._place(FieldMapping(name)) for name in EXTRA_KEY.get(self.sheet, ())]
        return [p.key_part for p in keys + [p for p in extra if p.on_both_sides]]

    @property
    def missing(self) -> list[str]:
        """Labels of the fields that the actual table has no column for."""
        return [p.field.s4_field for p in self.placed if p.actual is None]


def load_mapping(path: str) -> Mapping[str, list[FieldMapping]]:
    """Mapping file: ``{sheet: {"fields": [...]}}``."""
    sheets = json.loads(Path(path).read_text(encoding="utf-8"))
    return {sheet: [FieldMapping(**entry) for entry in body["fields"]] for sheet, body in sheets.items()}
