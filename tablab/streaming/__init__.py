"""Structured Streaming entry points.

The reference works on whole tables only; the streaming counterpart here is
replaying a fitted recipe (cleaning + transformations, all projections and
filters) on new files as they arrive, with an exactly-once file sink whose
progress is checkpointed in the shared checkpoint folder.
"""

from tablab.streaming.recipe_stream import apply_recipe_stream, read_stream, write_stream  # noqa: F401
