"""Unbounded inputs.

The footage work is batch only, so there is no stateful streaming operator here.
Everything in ``footstats.functions`` and the row-local operators (``parse_clock``,
``classify_phase``, ``box_features``, ``frame_keys``, ``clamp_intervals`` ...) use only
columns of the same row and may be applied to a streaming DataFrame as they are.
"""
