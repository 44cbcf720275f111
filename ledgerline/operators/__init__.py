from ledgerline.operators.geography import keep_nations, nations_in

__all__ = ["keep_nations", "nations_in"]
