"""Operations on training data: counting, packing, cleaning, linking and searching at corpus scale."""
