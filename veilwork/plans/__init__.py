from .keyfilter import KeyFilter, key_filter
from .lookup import lookup_join
from .numbering import sequence_table, with_dense_number, with_group_number
from .spread import deal
from .staging import clear_stages, run_folder, stage, stage_root

__all__ = ["KeyFilter", "clear_stages", "deal", "key_filter", "lookup_join", "run_folder", "sequence_table", "stage", "stage_root", "with_dense_number", "with_group_number"]
