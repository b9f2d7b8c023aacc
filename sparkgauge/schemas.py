"""Schemas of the JSON files and of the long tables made from them."""

from __future__ import annotations

STATES = ("present", "null", "missing")
AVAILABILITY = ("completed", "transport_failure", "contract_failure")

GOLDEN_LINE = "doc string, docClass string, schema string, fields map<string, struct<state: string, value: variant>>"
PROVENANCE = "struct<modelVersion: string, vendorVersion: string, calibratorVersion: string, apiVersion: string, requestId: string>"
PREDICTION_LINE = (
    "kind string, doc string, docClass string, repeat int, fields map<string, struct<value: variant, confidence: double>>, "
    f"availability string, requestAttempts int, transportRetries int, error string, provenance {PROVENANCE}"
)
SCORES_FILE = (
    "version int, corpus struct<f1: double, precision: double, recall: double, ece: double, brier: double, auroc: double>, "
    "points array<struct<confidence: double, correct: boolean>>, riskCoverage array<struct<coverage: double, error: double>>"
)
STRIKES_FILE = "auditedCells long, struck array<struct<docClass: string, doc: string, field: string, reason: string, page: int, seen: string>>"
NORMALIZER_FILE = "docClass string, normalizers map<string, string>"
NORMALIZER_KINDS = ("currency", "date", "text")
CHECKPOINT_KINDS = ("header", "prediction", "circuit_open", "manual_resume")
