"""creditloom: corporate credit underwriting for whole borrower books, expressed as Spark DataFrames."""
