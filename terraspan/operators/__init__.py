"""Operations on the object tables: DataFrames in, DataFrames out."""
