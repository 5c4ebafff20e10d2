"""cuespan.functions"""
