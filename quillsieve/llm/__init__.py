"""Training-data operators: ten scale-out components and the queries over them."""
