"""Plain-Python scan coder and container format: pure functions between bytes and sample arrays.

Near-lossless encoding and all decoding depend sample by sample on what
was reconstructed before, so a scan (or restart interval) is the unit of
parallel work; the operators run these functions over many of them.
"""
