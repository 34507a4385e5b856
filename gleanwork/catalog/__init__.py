"""Further registered queries, by subject."""

from . import dashboards, evaluation, extraction, folders, linking, listing, shapes, stored, streams, vocabularies  # noqa: F401
