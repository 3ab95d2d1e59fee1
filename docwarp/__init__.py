"""docwarp: a PySpark engine for permission-aware retrieval and life-cycle management of document corpora."""
