"""Model sink/source -- see ``tablab.operators.supervised.save_model`` /
``load_model`` (Spark ML model plus every fitted constant)."""

from tablab.operators.supervised import encode_for_model, load_model, save_model  # noqa: F401
