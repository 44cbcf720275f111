from ledgerline.sources.tables import SCHEMAS, file_problems, load

__all__ = ["SCHEMAS", "file_problems", "load"]
