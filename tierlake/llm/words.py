"""Common words of some languages: short words that carry grammar and stand in nearly every sentence."""

# Fixed values, for telling sentences from lists; one entry a language.
COMMON = {
    "en": "the of and to a in is it you that he was for on are with as his they be at this have from or had by but not what all were we when your can there an each which she do how their if will other about out many then them these so some her would him into has more no could my than been who its now did may over after only where most very just any our every another while near under between across without though although because until since during before against through nobody everyone i me us those am nor yet",
    "de": "der die das den dem des ein eine einen einem einer und oder aber sondern denn weil dass wenn als ob obwohl nicht kein keine ich du er sie es wir ihr man mein dein sein ihre ihr unser dieser diese dieses jede jeder jedes von vom zu zum zur in im an am auf aus bei mit nach für über unter gegen ohne um durch zwischen vor ist sind war hat haben wird auch noch schon nur sehr hier dort niemand",
    "fr": "le la les un une des du de et ou mais donc car que qui quoi dont où si quand lorsque parce je tu il elle on nous vous ils elles ce cet cette ces mon ton son notre votre leur leurs chaque aucun ne pas plus dans en sur sous avec sans pour par chez entre contre vers après avant près est sont était a ont très aussi bien ici là personne",
    "es": "el la los las un una unos unas de del al y o pero sino porque que quien cuando donde si aunque mientras yo tú él ella nosotros ustedes ellos ellas su sus mi tu nuestro nuestra este esta estos estas aquel aquella ese esa cada no en con sin por para desde hasta hacia entre sobre bajo tras cerca después antes es son era ha han muy más también ya nadie alguien",
    "nl": "de het een en of maar want dus dat die dit deze wie wat als toen omdat hoewel terwijl wanneer ik jij je hij zij ze wij we jullie men hun haar zijn mijn onze ons elke elk geen niet in op aan van voor met zonder bij naar over onder tegen tussen uit door is was heeft hebben wordt ook nog al zeer hier daar er niemand",
    "ga": "an na a agus nó ach mar gur go ná ní nach más má nuair sula cé is tá bhí mé tú sé sí sinn muid sibh siad mo do ár bhur seo sin gach i in ar ag as ó chuig roimh faoi le gan idir trí tar éis don den leis inár níl fós freisin anseo ansin duine",
    "ru": "и а но или что чтобы как если когда хотя где потому который я ты он она оно мы вы они его её их мой твой свой своя наш ваш этот эта это тот та то такой весь все каждый один в во на с со к ко по о об от до из за под над при без для между перед после около через не ни же бы ли уже ещё так там тут здесь был была было есть никто кто",
    "el": "ο η το οι τα του της των τον την ένας μια ένα και ή αλλά γιατί ότι που πως αν όταν επειδή ενώ όπου εγώ εσύ αυτός αυτή αυτό εμείς εσείς αυτοί μου σου μας σας τους κάθε αυτά σε στο στη στην στον από με για προς χωρίς κατά μετά πριν κάτω πάνω μεταξύ κοντά δεν μη να θα είναι ήταν έχει πολύ πιο εδώ εκεί κανείς",
    "it": "il lo la i gli le un una di del della dei delle e o ma perché che chi quando dove se io tu lui lei noi voi loro mio tuo suo nostro questo questa quello quella ogni non in con senza per da dal su tra fra sotto è sono era ha hanno molto anche già più",
    "pt": "o a os as um uma de do da dos das e ou mas porque que quem quando onde se eu tu ele ela nós vós eles meu teu seu nosso este esta esse essa aquele cada não em no na com sem por para desde até entre sobre sob é são era tem muito também já mais",
}
