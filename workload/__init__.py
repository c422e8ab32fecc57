"""Every operator of the library as a query over the test tables, each beside its SQL where SQL can say it."""
