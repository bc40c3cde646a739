"""Writers: tenant replace, keyed upsert, audit rows, artefacts."""
