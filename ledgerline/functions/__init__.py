from ledgerline.functions.scalars import (  # noqa: F401
    as_money,
    blank_to_null,
    flag,
    money_out,
    round2,
    segment_label,
    typed_null,
)
