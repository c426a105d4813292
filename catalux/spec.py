"""Configured sources and joins (the reference's YAML source blocks)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class JoinSpec:
    """One configured join: ``df.join(other, expr(on), how)`` with plain or aggregated fields.

    ``fields`` maps output name -> column of the joined table; with ``agg``
    ('array_agg', 'json_agg', 'jsonb_agg') the joined side is grouped by its
    join key first (pre-aggregation, so the left side never fans out).
    """

    table: str
    on_left: tuple[str, ...]
    on_right: tuple[str, ...]
    how: str = "left"
    fields: dict = field(default_factory=dict)
    agg: str | None = None
    distinct: bool = False
    order_by: str | None = None

    def __post_init__(self):
        if self.how not in ("left", "inner"):
            raise ValueError(f"join type {self.how!r} not supported (left or inner)")
        if self.agg not in (None, "array_agg", "json_agg", "jsonb_agg"):
            raise ValueError(f"aggregate {self.agg!r} not supported")


@dataclass(frozen=True)
class SourceSpec:
    """A searchable source: id, text, optional update time and extras."""

    name: str
    id_field: str
    text_field: str
    updated_at_field: str | None = None
    extra_fields: tuple[str, ...] = ()
    where: str | None = None
    keyword_fields: tuple[str, ...] = ()
    keyword_search: bool = True
    keyword_normalize: bool = False
    size_field: str | None = "size"
    ext_id_field: str = "tmdb_id"
    tagging_nsfw: bool = True
    joins: tuple[JoinSpec, ...] = ()
    scene_enrich: bool = False
    scene_key: tuple[str, str] | None = None  # (content_type, content_source) for scene matches
    film_refs: tuple[str, str] | None = None  # fields (extra ones) with the film type and id of a row

    @property
    def fields(self) -> set[str]:
        return {self.id_field, self.text_field, *self.extra_fields}
