"""Imports every query module, so that the registry is full."""

import importlib

MODULES = ["search_queries", "label_queries", "vector_queries", "evaluation_queries", "object_queries", "concept_queries", "learning_queries", "graph_queries", "lesson_queries", "stream_queries"]

for _m in MODULES:
    importlib.import_module(f"tomeflow.plans.{_m}")
