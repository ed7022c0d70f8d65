"""Prompt templates as Column expressions: text around values, one prompt a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = "You read device interface specifications. Answer with valid JSON only. Take every value from the text given; leave out what it does not say."


def _numbered(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")


def discovery(device: Column, chunks: Column) -> Column:
    """Which messages does the device speak?"""
    return F.concat(
        F.lit("The passages below come from the interface specification of the device "), device,
        F.lit(".\nList every message it names as a JSON array of objects with message_type, direction and description.\n\n"), _numbered(chunks),
    )


def message_fields(device: Column, message: Column, chunks: Column) -> Column:
    """Which fields does a message have?"""
    return F.concat(
        F.lit("For the message "), message, F.lit(" of the device "), device,
        F.lit(", list every field as a JSON array of objects with field_name, data_type, cardinality, description and example.\n\n"), _numbered(chunks),
    )


def samples(device: Column, message: Column, chunks: Column) -> Column:
    """Which examples of a message does the specification give?"""
    return F.concat(F.lit("Copy every example of the message "), message, F.lit(" of the device "), device, F.lit(" into a JSON array of strings, unchanged.\n\n"), _numbered(chunks))


def consolidation(device: Column, messages: Column) -> Column:
    """Put the parts together."""
    return F.concat(F.lit("Merge these messages of the device "), device, F.lit(" into one JSON object with a key a message; keep every field once.\n\n"), messages)


def refinement(missing: Column, data: Column, chunks: Column) -> Column:
    """Ask again for what is missing."""
    return F.concat(F.lit("These keys are still missing: "), F.array_join(missing, ", "), F.lit(".\nWhat is known: "), data, F.lit("\nAnswer with a JSON object of the missing keys alone.\n\n"), _numbered(chunks))
