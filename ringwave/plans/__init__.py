"""Result products: composed queries over the operators."""
