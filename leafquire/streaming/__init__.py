"""Empty on purpose: the jobs have no stream operators, watermarks or time windows.

Work that follows changes is the digest anti-join of ``sources.tables.new_digests``.
"""
