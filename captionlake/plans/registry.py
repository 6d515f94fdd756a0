"""Every query outside the removable part, by name, with its DuckDB SQL."""

from captionlake.plans import captions, records, speech, sql

QUERIES = {**captions.QUERIES, **speech.QUERIES, **records.QUERIES}
ORACLES = {**captions.ORACLES, **speech.ORACLES, **records.ORACLES, **sql.ORACLES}
