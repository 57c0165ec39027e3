"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Shared helpers: `rows`
(row ids, sizing, packed exchange), `arrays` (vectorised text hashing inside
tasks), `sketch` (count-min with two-bit counters), `scans` (native global
prefix sums).  One module per operator; `queries` registers them.
"""
