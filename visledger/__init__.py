"""Annotated-media manifests as Spark tables: reading, selecting, editing, checking, describing and evaluating them."""
