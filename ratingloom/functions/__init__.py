"""Column-level helpers shared by the operators."""

from ratingloom.functions.ids import hash_slot, id_order, md5_part
from ratingloom.functions.scoring import jvm_divide, share, top_k

__all__ = ["hash_slot", "id_order", "jvm_divide", "md5_part", "share", "top_k"]
