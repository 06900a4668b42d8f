"""The log as a stream: idempotent projection, watermarks, windows and keyed state, on the batch path's functions."""
