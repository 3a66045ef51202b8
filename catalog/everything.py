"""Import every module that registers queries."""

from catalog import corpora, fields, files, graphs, layouts, messages, rooms, sampling, scoring, timeline  # noqa: F401
